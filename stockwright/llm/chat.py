"""Chat formatting at token level.

A conversation becomes one sequence of token ids: a start id, then for each turn ``<|turn|>``, the role's ids,
``<|says|>``, the text's ids, ``<|end|>``.  The reserved ids lie above the vocabulary and are spliced in between
segments that are encoded by themselves, so no text can ever produce one.  Strings that look like control marks inside
a role or text are escaped (one backslash more after their first character), which makes the written form unambiguous
too; reading back takes that backslash away.  Which characters and tokens are under the loss follows from prefix sums
of the segment lengths.

A row per turn is encoded where it is read.  Turns then meet by conversation, in order, and are put together as they
stream by; a conversation is never held as a group of rows, only as its own output.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import read_vocabulary
from .common import narrow, slices

#: Control strings of public chat templates and vocabularies.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>",
           "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>")
#: This template's own marks; ids are given above the vocabulary in this order.
MARKS = ("<|chat|>", "<|turn|>", "<|says|>", "<|end|>")
TRAINED_ROLE = "assistant"
#: Bytes of turns encoded at once: the library holds some hundred bytes for each token of them.
SLICE = 1 << 18

_TAILS = "|".join(re.escape(s[1:]) for s in sorted({*CONTROL, *MARKS}, key=lambda s: (-len(s), s)))
_PLAIN = re.compile(rf"(?<=[<\[])(?=\\*(?:{_TAILS}))")
_ESCAPED = re.compile(rf"(?<=[<\[])\\(?=\\*(?:{_TAILS}))")
_CUT = re.compile("|".join(map(re.escape, MARKS)))


def escape(text: str) -> str:
    """``text`` with a backslash put into every control string (and into what already looks like an escaped one)."""
    return _PLAIN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


@lru_cache(maxsize=1)
def _tokenizer(source: str) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of a worker's own only add memory
    made = tokenizers.Tokenizer.from_str(source)
    made.encode_special_tokens = True  # strings of special tokens are ordinary text
    return made


def formatted(chats: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``ids`` (array<int>), ``loss`` (array<boolean>, per id), ``formatted``
    (the written form) and ``spans`` (array<struct<start,end>>: code points of the written form under the loss).

    Turns are ordered by ``turn``, NULL first; rows with equal turn by role, then text, and repeated rows each count.
    NULL roles and texts are empty.  Rows with a NULL conversation form one conversation.  The loss covers each text of
    the assistant, nothing around it.  An empty table gives no row.
    """
    source = read_vocabulary(chats.sparkSession, vocabulary)
    turns = _encoded(chats, source, conv, turn, role, text)
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_assembler(source), f"conv_id {conv_type}, ids array<int>, loss array<boolean>, formatted string, spans array<struct<start:bigint,end:bigint>>")


def _encoded(chats: DataFrame, source, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per turn with the written forms and ids of its role and text; turns of a conversation follow each other."""
    df = narrow(chats, conv_id=conv, turn=turn, role=role, text=text)
    conv_type, turn_type = (df.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _tokenizer(source.value)
        for b in (x for whole in batches for x in slices(whole, SLICE)):
            roles, texts = ([t or "" for t in b.column(i).to_pylist()] for i in (2, 3))
            trained = pa.array([r == TRAINED_ROLE for r in roles])
            columns = []
            for segments in (roles, texts):
                written = [escape(s) for s in segments]
                ids = [e.ids for e in made.encode_batch(written, add_special_tokens=False)]
                columns += [pa.array(written, pa.string()), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, trained], ["conv_id", "turn", "role", "role_ids", "text", "text_ids", "trained"])

    turns = df.mapInArrow(encode, f"conv_id {conv_type}, turn {turn_type}, role string, role_ids array<int>, text string, text_ids array<int>, trained boolean")
    tasks = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _assembler(source):
    """Puts the turns of ``_encoded`` together, conversation by conversation, as they stream by."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _tokenizer(source.value).get_vocab_size()
        chat, says_turn, says, end = (first + i for i in range(4))
        out: list[tuple] = []
        now = None

        def close() -> None:
            conv_id, segments = now
            sizes = np.array([len(i) for i, _, _ in segments])
            chars = np.array([len(w) for _, w, _ in segments])
            covered = np.array([t for _, _, t in segments])
            char_end = np.cumsum(chars)
            spans = [{"start": int(e - n), "end": int(e)} for e, n, c in zip(char_end, chars, covered) if c]
            out.append((conv_id, np.concatenate([np.asarray(i, np.int32) for i, _, _ in segments]), np.repeat(covered, sizes),
                        "".join(w for _, w, _ in segments), spans))

        def flush() -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.list_(pa.int32())),
                       pa.array([r[2] for r in out], pa.list_(pa.bool_())), pa.array([r[3] for r in out], pa.string()), pa.array([r[4] for r in out], span)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "ids", "loss", "formatted", "spans"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            rows = [c.to_pylist() for c in b.columns]
            for conv_id, _, role_, role_ids, text_, text_ids, trained in zip(*rows):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        close()
                    now = (conv_id, [([chat], MARKS[0], False)])
                    if len(out) >= 256:
                        yield flush()
                now[1].extend([([says_turn], MARKS[1], False), (role_ids, role_, False), ([says], MARKS[2], False),
                               (text_ids, text_, trained), ([end], MARKS[3], False)])
        if now is not None:
            close()
            yield flush()

    return assemble


def read_turns(written: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a written conversation."""
    parts = _CUT.split(written)
    if _CUT.findall(written) != [MARKS[0]] + [*MARKS[1:]] * (len(parts) // 3):
        raise ValueError("not a written conversation")
    return [(unescape(parts[i]), unescape(parts[i + 1])) for i in range(2, len(parts) - 1, 3)]


def report(chats: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What ``formatted`` writes, read back: the ids are decoded, cut at the reserved ids and unescaped, and compared
    with the written form; the loss text comes from the token mask and must equal the character spans.

    Rows are read back in the worker that wrote them: a second worker a task would hold the vocabulary once more.
    """
    source = read_vocabulary(chats.sparkSession, vocabulary)
    turns, assemble = _encoded(chats, source, conv, turn, role, text), _assembler(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(source.value)
        first = tokens.get_vocab_size()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in assemble(batches):
            rows = []
            for _, ids, loss, written, spans in zip(*[c.to_pylist() for c in b.columns]):
                ids, loss = np.array(ids), np.array(loss, bool)
                special = np.flatnonzero(ids >= first)
                bounds = np.r_[special, len(ids)]
                segments = [ids[a + 1 : z] for a, z in zip(bounds, bounds[1:])]
                decoded = tokens.decode_batch([s.tolist() for s in segments], skip_special_tokens=False)
                under = [bool(loss[a + 1]) if z > a + 1 else False for a, z in zip(bounds, bounds[1:])]
                again = "".join(MARKS[i - first] + d for i, d in zip(ids[special], decoded))
                turns = read_turns(again)
                trained = "".join(unescape(d) for d, u in zip(decoded, under) if u)
                by_span = "".join(unescape(written[s["start"] : s["end"]]) for s in spans)
                if again != written or trained != by_span:
                    raise ValueError("a conversation can't be read back")
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), sha(whole), len(trained), sha(trained), len(written)))
            columns_ = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns_, kinds)]],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_control_case(spark: SparkSession, chats: DataFrame) -> DataFrame:
    """``chats`` and conversation -7, whose user and assistant say control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chats.select("conv_id", "turn", "role", "text").unionByName(extra.select(*[F.col(c).cast(chats.schema[c].dataType) for c in extra.columns]))
