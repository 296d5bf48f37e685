"""Passages that occur more than once: blockwise suffix buckets behind a difference-cover sample.

Every byte covered by a 400-byte string that starts anywhere else goes.  Suffixes matter only to 400 bytes, so they are
named by rolling hashes of what they begin with, and buckets are ranges of names, each sorted by itself in one task.

1.  The cover sample.  A difference cover of 307 holds 18 residues such that any two places have a common shift, below
    307, that brings both onto sample places.  So two equal 400-byte strings share a sample place with 94 equal bytes.
    The sample's names are sorted a bucket at a time; a place whose name occurs once is in no repeat, and only suffixes
    next to a repeated sample place go on.
2.  Long ties.  Where a repeat goes on for long, all its suffixes tie with those of its copies.  They are resolved
    together: from one content-defined anchor to the next, a string of the gap plus 400 bytes is named; if it is
    repeated, every suffix in the gap is.  One member of each such class stands for it in the next step.
3.  The rest: suffixes not yet resolved are sorted by their names with the standing members, a bucket at a time.

A task holds one bucket at a time; the number of buckets follows the number of names, but all places of one name are in
one bucket.  Exact copies of a text are looked at once; all of their bytes go.

A passage of over 50 words may have fewer than 400 bytes.  None of its bytes go, but it is reported: of any 14 consecutive
38-word strings the one of least name is sent, so texts that share 51 words send a string in common.  The names are sorted
in buckets like the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, narrow, parts, slices, stored

LENGTH = 400
ORDER = 17
COVER = ORDER * ORDER + ORDER + 1
#: Bytes that two equal strings still share at their common sample place.
SHARED = LENGTH - COVER + 1
ANCHOR_BYTES = 12
ANCHOR_EVERY = 32
#: Names that a task sorts together.
BUCKET_ROWS = 2_000_000
PIECE = 1 << 21
KEY_BYTES = 16
#: Bytes of a sample place's name that are sent.
SAMPLE_BYTES = 6

#: Words of a shared passage that is reported in any case, and of the strings that are compared to find it.
PASSAGE = 51
GRAM = 38
#: Of such a string's name so many bits more are sent than tell all of them apart.
SPARE_BITS = 18

_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=1)
def difference_cover(q: int = ORDER) -> np.ndarray:
    """A perfect difference set modulo q*q + q + 1, for a prime q: the powers of a generator of GF(q^3) that lie in a plane."""
    size = q * q + q + 1
    for a, b, c in ((a, b, c) for c in range(1, q) for b in range(q) for a in range(q)):
        x, found = (1, 0, 0), []
        for i in range(size):
            if x[2] == 0:
                found.append(i)
            x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)  # times x, with x^3 = a x^2 + b x + c
        if len(found) == q + 1 and len({(i - j) % size for i in found for j in found}) == size:
            return np.array(found)
    raise ValueError(f"{q} is no prime")


@lru_cache(maxsize=1)
def _tables(n: int = PIECE + 2 * LENGTH + 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the factor's powers and inverse powers."""
    power, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _FACTOR, np.uint64), out=power[1:])
    np.multiply.accumulate(np.full(n - 1, pow(_FACTOR, -1, 1 << 64), np.uint64), out=inverse[1:])
    return np.random.default_rng(4).integers(0, 1 << 63, 256).astype(np.uint64), power, inverse


def names(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """64-bit names of the strings that begin at ``starts`` (ascending); equal strings have equal names anywhere."""
    letter, power, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    for base in range(0, len(data), PIECE):
        a, z = np.searchsorted(starts, [base, base + PIECE])
        if a == z:
            continue
        some = data[base : base + PIECE + 2 * LENGTH + 32]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(letter[some] * power[: len(some)], out=total[1:])
        at = starts[a:z] - base
        upto = at + (lengths if isinstance(lengths, int) else lengths[a:z])
        out[a:z] = (total[upto] - total[at]) * inverse[at]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sample_places(n: int) -> np.ndarray:
    """The cover's places in a text of n bytes at which a shared string fits."""
    cover = difference_cover()
    last = n - SHARED
    places = (np.arange(0, last + 1, COVER)[:, None] + cover).ravel()
    return places[places <= last]


def gaps(data: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and the next ones, where all suffixes from one to the other are ``wanted``."""
    n = len(data)
    marks = []
    for base in range(0, n - ANCHOR_BYTES + 1, PIECE):
        at = np.arange(base, min(base + PIECE, n - ANCHOR_BYTES + 1))
        marks.append(at[names(data, at, ANCHOR_BYTES) % np.uint64(ANCHOR_EVERY) == 0])
    anchor = np.concatenate(marks) if marks else np.empty(0, np.int64)
    a, b = anchor[:-1], anchor[1:]
    fits = (b + LENGTH <= n) & (b - a <= LENGTH)
    a, b = a[fits], b[fits]
    upto = np.r_[0, np.cumsum(wanted)]
    full = upto[b + 1] - upto[a] == b + 1 - a
    return a[full], b[full]


def near_hits(n: int, hits: np.ndarray) -> np.ndarray:
    """For each start of a 400-byte string: is a repeated sample place at the right distance?"""
    there = np.zeros(n + 1, np.int64)
    there[hits + 1] = 1
    upto = np.cumsum(there)
    start = np.arange(n - LENGTH + 1)
    return upto[start + COVER] > upto[start]


def word_names(data: np.ndarray) -> np.ndarray:
    """64-bit names of the words (runs without ASCII white space), in order."""
    letter, power, _ = _tables()
    out = []
    for part in parts(data.tobytes()):
        some = np.frombuffer(part, np.uint8)
        inside = (some != 32) & ((some < 9) | (some > 13))
        at = np.flatnonzero(inside)
        if len(at):
            head = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            start = np.repeat(at[head], np.diff(np.r_[head, len(at)]))
            out.append(np.add.reduceat(letter[some[at]] * power[(at - start) & 0xFFFF], head))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def passage_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the chosen ``GRAM``-word strings and the numbers of their first words."""
    _, power, inverse = _tables()
    word = word_names(data)
    width = PASSAGE - GRAM + 1
    found, places = [], []
    for base in range(0, max(0, len(word) - PASSAGE + 1), PIECE):
        some = word[base : base + PIECE + PASSAGE - 1]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * power[: len(some)], out=total[1:])
        name = (total[GRAM:] - total[:-GRAM]) * inverse[: len(some) - GRAM + 1]
        name ^= name >> np.uint64(32)
        name *= np.uint64(0xD6E8FEB86659FD93)
        name ^= name >> np.uint64(29)
        n = len(name) - width + 1
        least = name[:n].copy()
        for j in range(1, width):
            np.minimum(least, name[j : j + n], out=least)
        padded = np.zeros(n + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + n] = least
        most = padded[: len(name)].copy()  # the largest least name of the windows that hold each string
        for j in range(1, width):
            np.maximum(most, padded[j : j + len(name)], out=most)
        at = np.flatnonzero(most == name)
        found.append(name[at])
        places.append(at + base)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)  # pieces overlap
    return np.concatenate(found)[first], place


# --- buckets ---------------------------------------------------------------------------------------------------

#: The highest bit of a place: an answer is wanted.
ASKED = np.uint32(1 << 31)


def packed(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width]).tobytes()


def unpacked(data: bytes, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(kind).ravel()


def dealt(key: list[bytes], entries: list[tuple[np.ndarray, np.ndarray]], buckets: int, width: int) -> pa.RecordBatch:
    """Rows (bucket, keys, names, texts, places): what the texts of a slice send to each bucket.

    ``width``: bytes of a name that are sent.  The sample only filters, so six do there: a chance twin costs work, not truth.
    """
    name = np.concatenate([e[0] for e in entries]) >> np.uint64(64 - 8 * width)
    place = np.concatenate([e[1] for e in entries]).astype(np.uint32)
    text = np.repeat(np.arange(len(entries), dtype=np.uint32), [len(e[0]) for e in entries])
    order = np.argsort(name, kind="stable")
    name, place, text = name[order], place[order], text[order]
    bucket = ((name >> np.uint64(8 * width - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    keys = np.frombuffer(b"".join(key), np.uint8).reshape(-1, KEY_BYTES)
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        who, inner = np.unique(text[s], return_inverse=True)
        small = inner.astype(np.uint16 if len(who) < 1 << 16 else np.uint32)
        where, asked = place[s] & ~ASKED, (place[s] >= ASKED).astype(np.uint32)
        short = int(where.max()) < 1 << 23  # three bytes, the wish in the highest bit
        where |= asked << np.uint32(23 if short else 31)
        rows.append((int(b), keys[who].tobytes(), packed(name[s], width), small.tobytes(), packed(where, 3 if short else 4)))
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                      ["bucket", "keys", "names", "texts", "places"])


DEALT = "bucket int, keys binary, names binary, texts binary, places binary"
KEY = np.dtype((np.void, KEY_BYTES))


def resolved(rows: DataFrame, buckets: int, width: int, across: bool = False) -> DataFrame:
    """``key``, ``places``, ``first``, a row per text: the places whose name occurs at another place too (``across``: in
    another text), ascending, and for each whether it is its class's first.  Each bucket is sorted by itself; its answers are packed by bins of
    texts, and each bin puts its texts' answers together."""

    def solve(held: list[list[bytes]]) -> pa.RecordBatch:
        own, number = np.unique(np.concatenate([np.frombuffer(k, KEY) for k, *_ in held]), return_inverse=True)
        name = np.concatenate([unpacked(x[1], width, np.uint64) for x in held])
        text, place, base = [], [], 0
        for k, n, t, p in held:
            rows = len(n) // width
            text.append(number[base + np.frombuffer(t, np.uint16 if len(t) == 2 * rows else np.uint32).astype(np.int64)])
            some = unpacked(p, len(p) // rows, np.uint32)
            place.append((some & np.uint32(0x7FFFFF)) | (some >> np.uint32(23)) << np.uint32(31) if len(p) == 3 * rows else some)
            base += len(k) // KEY_BYTES
        text, place = np.concatenate(text).astype(np.int64), np.concatenate(place)
        order = np.lexsort((place & ~ASKED, text, name))
        name, place, text = name[order], place[order], text[order]
        where = place & ~ASKED
        new = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1]) | (where[1:] != where[:-1])]
        name, place, text, where = name[new], place[new], text[new], where[new]  # copies of a text count once
        head = np.r_[True, name[1:] != name[:-1]]
        if across:
            begin = np.flatnonzero(head)
            size = np.diff(np.r_[begin, len(head)])
            want = np.repeat(text[begin] != text[begin + size - 1], size)
        else:
            want = ~head | ~np.r_[head[1:], True]
        want &= place >= ASKED
        text, where, head = text[want], where[want], head[want]
        # bins of texts: by the first bytes of their keys
        lead = own.view(np.uint8).reshape(-1, KEY_BYTES)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        bins = (lead * buckets >> 32)[text]
        order = np.lexsort((where, text, bins))
        text, where, head, bins = text[order], where[order], head[order], bins[order]
        made = []
        for z in np.unique(bins):
            a, e = np.searchsorted(bins, [z, z + 1])
            who, n = np.unique(text[a:e], return_counts=True)  # ascending, as the rows are
            made.append((int(z), own[who].tobytes(), n.astype(np.uint32).tobytes(), where[a:e].tobytes(), np.packbits(head[a:e]).tobytes()))
        columns = list(zip(*made)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bin", "keys", "n", "places", "first"])

    def merge(held: list[list[bytes]]) -> pa.RecordBatch:
        own, number = np.unique(np.concatenate([np.frombuffer(k, KEY) for k, *_ in held]), return_inverse=True)
        text = np.repeat(number, np.concatenate([np.frombuffer(n, np.uint32) for _, n, _, _ in held]))
        place = [np.frombuffer(p, np.uint32) for _, _, p, _ in held]
        first = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(p)) for (*_, f), p in zip(held, place)])
        place = np.concatenate(place)
        order = np.lexsort((place, text))
        text, place, first = text[order], place[order], first[order]
        edge = np.searchsorted(text, np.arange(len(own) + 1)).tolist()
        spans = list(zip(edge, edge[1:]))
        return pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in own], pa.binary()), pa.array([place[a:z].tobytes() for a, z in spans], pa.binary()),
                                           pa.array([np.packbits(first[a:z]).tobytes() for a, z in spans], pa.binary())], ["key", "places", "first"])

    answers = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _grouped(batches, solve), "bin int, keys binary, n binary, places binary, first binary")
    return answers.repartition(buckets, "bin").sortWithinPartitions("bin").mapInArrow(
        lambda batches: _grouped(batches, merge), "key binary, places binary, first binary")


def _grouped(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """``done(rows)`` for the rows of each value of the first column, which come one value after another."""
    now, held = None, []
    for b in batches:
        for value, *rest in zip(*[c.to_pylist() for c in b.columns]):
            if now is not None and value != now:
                yield done(held)
                held = []
            now = value
            held.append(rest)
    if held:
        yield done(held)


def named(found: DataFrame, name: str) -> DataFrame:
    return found.select("key", F.struct("places", "first").alias(name))


def places_of(answer: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places, and whether each is its class's first."""
    if not answer:
        return np.empty(0, np.int64), np.empty(0, bool)
    place = np.frombuffer(answer["places"], np.uint32).astype(np.int64)
    return place, np.unpackbits(np.frombuffer(answer["first"], np.uint8), count=len(place)).astype(bool)


def _sent(df: DataFrame, make, buckets: int, width: int = 8) -> DataFrame:
    """``make(row) -> (names, places)`` of every row, dealt to buckets; rows begin with key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            seen, keys, entries = set(), [], []
            for key, text, *rest in zip(*[c.to_pylist() for c in b.columns]):
                if key not in seen:  # copies in one slice
                    seen.add(key)
                    keys.append(key)
                    entries.append(make(np.frombuffer(text, np.uint8), *rest))
            if entries:
                yield dealt(keys, entries, buckets, width)

    return df.mapInArrow(run, DEALT)


def _sampled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = sample_places(len(data))
    return names(data, at, SHARED), at | int(ASKED)


def _passages(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = passage_names(data)[0]
    return name, np.full(len(name), int(ASKED))  # only the text matters, not the place


def _long_ties(data: np.ndarray, hits: dict) -> tuple[np.ndarray, np.ndarray]:
    a, b = gaps(data, near_hits(len(data), places_of(hits)[0]))
    return names(data, a, b - a + LENGTH), a | int(ASKED)


def _cover(data: np.ndarray, hits: dict, ties: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which starts may be repeated, which are known to be, and which stand for a class of long ties."""
    wanted = near_hits(len(data), places_of(hits)[0])
    known, standing = np.zeros(len(wanted) + 1, np.int32), np.zeros(len(wanted) + 1, np.int32)
    place, first = places_of(ties)
    if len(place):
        a, b = gaps(data, wanted)
        b = b[np.searchsorted(a, place)]
        for mark, some in ((known, slice(None)), (standing, first)):
            np.add.at(mark, place[some], 1)
            np.add.at(mark, b[some] + 1, -1)
    return wanted, np.cumsum(known[:-1]) > 0, np.cumsum(standing[:-1]) > 0


def _rest(data: np.ndarray, hits: dict, ties: dict | None) -> tuple[np.ndarray, np.ndarray]:
    wanted, known, standing = _cover(data, hits, ties)
    at = np.flatnonzero(wanted & (~known | standing))
    return names(data, at, LENGTH), at | np.where(known[at], 0, int(ASKED))


def _outcome(text: bytes, repeated: np.ndarray) -> tuple[int, int, str]:
    """Bytes and runs removed, and the digest of what is left, when the strings at these starts are repeated."""
    mark = np.zeros(len(text) + 1, np.int32)
    start = np.flatnonzero(repeated)
    mark[start] += 1
    mark[start + LENGTH] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (the digest of the bytes
    left when every byte covered by a repeated 400-byte string is removed) and ``n_shared``.

    ``n_shared``: of the chosen strings of ``GRAM`` words, the number that also stand in another document.  It is above 0
    where ``PASSAGE`` words are shared and never for fewer than ``GRAM``; for copies with ``PASSAGE`` words it is 1 at least.

    NULL texts are empty; texts below 400 bytes keep all.  Strings don't cross documents and are judged on the input.
    Repeated rows are copies of each other: all their bytes go if they have 400.  An empty table gives no row.
    """
    df = narrow(docs, doc_id=id, text=text)
    whole = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    digest = F.sha2("text", 256)
    key = F.unhex(F.substring(digest, 1, 2 * KEY_BYTES))
    octets, words = F.octet_length("text"), F.regexp_count(F.col("text").cast("string"), F.lit(WORD))
    marked = stored(whole.select("doc_id", octets.cast("bigint").alias("n_bytes"), digest.alias("sha"), F.when(octets >= 2 * PASSAGE - 1, words).otherwise(0).alias("n_words")), "suffix-texts")
    copies = marked.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
    total = marked.where(F.col("n_bytes") >= LENGTH).agg(F.sum("n_bytes")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = lambda rows: max(least, -(-int(rows) // BUCKET_ROWS))

    long = whole.where(F.octet_length("text") >= LENGTH).select(key.alias("key"), "text")
    n = buckets(total * (ORDER + 1) / COVER)
    hits = named(resolved(_sent(long, _sampled, n, SAMPLE_BYTES), n, SAMPLE_BYTES), "hits")
    once = long.groupBy("key").agg(F.first("text").alias("text"))
    candidates = stored(once.join(hits, "key"), "suffix-candidates")
    size = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets(size / ANCHOR_EVERY)
    ties = stored(named(resolved(_sent(candidates.select("key", "text", "hits"), _long_ties, n), n, 8), "ties"), "suffix-ties")
    # read twice in the last plan below, where Spark shuffles the texts once and reuses the exchange
    tied = candidates.join(ties, "key", "left").select("key", "text", "hits", "ties")
    n = buckets(size)
    rest = named(resolved(_sent(tied, _rest, n), n, 8), "rest")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for _, t, h, l, r in zip(*[c.to_pylist() for c in b.columns]):
                known = _cover(np.frombuffer(t, np.uint8), h, l)[1]
                known[places_of(r)[0]] = True
                made.append(_outcome(t, known))
            c = list(zip(*made)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())],
                                             ["key", "n_removed", "n_spans", "kept"])

    cleaned = tied.join(rest, "key", "left").select("key", "text", "hits", "ties", "rest").mapInArrow(
        finish, "key binary, n_removed bigint, n_spans bigint, kept string").where("n_removed > 0")
    outcome = copies.withColumn("key", F.unhex(F.substring("sha", 1, 2 * KEY_BYTES))).join(cleaned, "key", "left").select("sha", "copies", "n_removed", "n_spans", "kept")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    many = (marked.agg(F.sum("n_words")).first()[0] or 0) * 2 // (PASSAGE - GRAM + 2)
    n, width = buckets(many), min(8, max(6, -(-(int(many).bit_length() + SPARE_BITS) // 8)))
    several = whole.where(octets >= 2 * PASSAGE - 1).select(key.alias("key"), "text")
    shared = resolved(_sent(several, _passages, n, width), n, width, across=True).select("key", (F.octet_length("places") / 4).cast("bigint").alias("shared"))
    found = marked.withColumn("key", F.unhex(F.substring("sha", 1, 2 * KEY_BYTES))).join(outcome, "sha").join(shared, "key", "left")
    return found.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.greatest(F.coalesce("shared", F.lit(0)), ((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)).cast("bigint")).alias("n_shared"))
