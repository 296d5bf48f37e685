"""Importance resampling, tokenizer alignment and toxicity: brute force, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockwright.llm import alignment, importance, toxicity
from stockwright.llm.bpe import byte_letters
from stockwright.llm.queries import PIECE_MODEL, VOCABULARY

from .test_edges import CLASHING, LONG, ROWS, RUN


@pytest.fixture(scope="module")
def edge(spark):
    made = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.withColumns({c: F.lit(f"{c}?") for c in [*CLASHING, "line", "digest", "codes", "weight", "features", "pairs", "fold", "margin", "toxic"]})


# --- importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_resample(docs, target):
    buckets = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    words = [plain_words(t) for _, t in docs]
    features = [buckets(w) for w in words]
    s, t = Counter(b for f in features for b in f), Counter(b for x in target for b in buckets(plain_words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for (i, _), w, f in zip(docs, words, features):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = Counter()
    for place, r in enumerate(able[: 5 * len(able) // 100], 1):
        drawn[(*r[:4], place)] += 1
    for r in able[5 * len(able) // 100 :] + [r for r in rows if r[4] < 20]:
        drawn[(*r[:4], None)] += 1
    return drawn


def test_resampling_equals_brute_force(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "Gamma", "d3", "é", "ÀB", "x"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(rng.randint(1, 8)) for _ in range(5)] + ["", "--", "one"]
    docs = [(i, rng.choice(["\n", "\n\n", "\r\n"]).join(rng.choice(common) if rng.random() < 0.6 else line(rng.randint(0, 9)) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    docs += [(None, line(30)), (None, None), (7, docs[7][1]), (7, docs[7][1])] + [(900, "same words " * 15)] * 120
    target = [line(12), "beta\nbeta gamma", None, ""]
    found = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, found.collect())) == plain_resample(docs, target)


def test_lines_that_are_joined_weigh_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c\nd {i % 5} e\nf g\n{i}\nh i j k") for i in range(60)], "doc_id bigint, text string")
    target = docs.select("text").limit(3)
    once = sorted(map(tuple, importance.weigh(docs, target).collect()))
    monkeypatch.setattr(importance, "SHARE", 10.0)  # no line is broadcast
    assert sorted(map(tuple, importance.weigh(docs, target).collect())) == once


def test_resampling_edges(edge):
    found = importance.resample(edge, edge.limit(0)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    assert {r["doc_id"]: (r["n_features"], r["weight"]) for r in found if r["doc_id"] in (1, 2, 3)} == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert importance.resample(edge.limit(0), edge).count() == 0


# --- tokenizer alignment


def plain_groups(text, a, b, a_bytes):
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled_a = [a_bytes[i] for i in ids_a]
    spelled_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
        return None
    ends = []
    for spelled in (spelled_a, spelled_b):
        at, own = 0, []
        for s in spelled:
            at += len(s)
            own.append(at)
        ends.append(own)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        a0, b0 = i, j
        i, j = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((ids_a[a0:i], ids_b[b0:j]))
    return groups


def plain_alignment(texts):
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a.encode_special_tokens = True
    letters = {c: n for n, c in byte_letters().items()}
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    groups = [plain_groups(t, a, b, a_bytes) for t in texts]
    counts = Counter(p for g in groups if g for p in {(x, y) for one, two in g for x in one for y in two})
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for g in groups:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for one, two in g for x in one for y in two]
        shown = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in g)
        out.append((sum(len(one) for one, _ in g), sum(len(two) for _, two in g), len(g), len(links), sum(counts[p] == highest[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", " ", " \n\t ", "plain words, twice: plain words", "<|endoftext|> </s> <s> <0x0A> \x00\x7f", "a▁b", "日本語 テキスト é́ \U0001F600‍", "-" * 700 + "=" * 300,
         "word" * 300, "x" * 3000, "tab\tand  two   spaces\n\n\nlines"]


@pytest.mark.parametrize("share", [alignment.SHARE, 10.0])
def test_alignment_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(alignment, "SHARE", share)
    monkeypatch.setattr(alignment, "PAIRS", 500)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()] + TEXTS
    found = alignment.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), VOCABULARY, PIECE_MODEL).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == plain_alignment(texts)


def test_alignment_edges(edge):
    found = alignment.report(edge, VOCABULARY, PIECE_MODEL).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    by = {r["doc_id"]: r for r in found}
    assert all(tuple(by[i][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "") for i in (1, 2)) and by[3]["n_a"] > 0
    pair = alignment.load(open(VOCABULARY, encoding="utf-8").read(), open(PIECE_MODEL, "rb").read())
    for i, text in ((4, LONG), (8, RUN)):
        assert (by[i]["n_a"], by[i]["n_b"]) == tuple(len(x[0]) for x in pair.encode([text]))
    assert by[5]["count_sum"] >= 3 * by[5]["n_links"]
    assert alignment.report(edge.limit(0), VOCABULARY, PIECE_MODEL).count() == 0


def test_aligned_spells_the_groups(spark):
    row = alignment.aligned(spark.createDataFrame([(1, "hello there")], "doc_id int, text string"), VOCABULARY, PIECE_MODEL).first()
    assert row["groups"].count(";") == row["n_groups"] - 1 and row["groups"].count("|") == row["n_groups"]


# --- toxicity


def labelled_texts(n=900, seed=3):
    rng = random.Random(seed)
    plain = ["house", "river", "green", "walk", "stone", "paper", "letter", "window", "garden", "music", "table", "winter"]
    bad = ["vilewort", "snarkle"] + [f"grumb{end}" for end in ("el", "ing", "ard", "ous", "ish", "ette")]
    rows = []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(15, 60))], rng.random() < 0.2
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_texts_are_caught_on_held_out_documents(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, "you snarkle, v1lewort!! grumbarian"), (5001, None), (5002, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5002, None)], "doc_id bigint, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_texts(docs, labels).collect()}
    truth = {i: toxic for i, _, toxic in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found) and len(found) == len(rows) + 3
    caught = [found[i]["predicted"] for i in held if truth[i]]
    assert sum(caught) >= 0.95 * len(caught) and sum(found[i]["predicted"] for i in held if not truth[i]) <= 1
    assert found[5000]["predicted"] == 1 and found[5001]["score"] == found[5002]["score"] < 0.7
    # nothing is learned from the labels of held-out documents
    other = toxicity.score_texts(docs, labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert {r["doc_id"]: r["score"] for r in other.collect()} == pytest.approx({i: r["score"] for i, r in found.items()})


def test_words_are_weighed_by_term_stem_and_mask():
    codes = toxicity.Codes({"idiot": 4.0, "grum*": 2.0, "grumble": 1.0})
    weight = lambda w: (codes[w] & codes.WEIGHT) / 100
    assert [weight(w) for w in ("idiot", "idiot!!", "1d1ot", "i.d.i.o.t", "grumble", "grum", "fine")] == [4.0, 4.0, 4.0, 4.0, 2.0, 0.0, 0.0]
    assert codes["1d1ot"] & codes.HIDDEN and codes["1d1ot"] & codes.MASKED and codes["grumble"] & codes.STEM and codes["you,"] & codes.SECOND
    values = dict(zip(toxicity.FEATURES, toxicity.features_of("YOU are an idiot", codes)))
    assert values["near_share"] == 1 and values["strong"] == 1 and values["nearest"] == 0.25 and values["shouted"] == 0.25 and values["capitals"] == pytest.approx(3 / 13)
    assert toxicity.terms_of("(grumbles)") == ("grumbles", "gru*", "grum*", "grumb*", "grumbl*", "grumble*")


def test_lexicon_counts_against_a_plain_count(spark):
    rows = [(t, y, i % toxicity.FOLDS) for i, (_, t, y) in enumerate(labelled_texts(200))]
    counts = toxicity.term_counts(spark.createDataFrame(rows, "text string, label int, fold int").repartition(3))
    found = {r["term"]: [r[f"c{i}"] for i in range(2 * toxicity.FOLDS)] for r in counts.collect()}
    for term in (None, "vilewort", "grumb*", "house"):
        want = [0] * (2 * toxicity.FOLDS)
        for t, y, f in rows:
            want[2 * f + y] += term is None or any(term in toxicity.terms_of(w) for w in t.split())
        assert found[term] == want


def test_toxicity_edges(edge, spark):
    for labels in (spark.createDataFrame([(4, 1), (5, 0), (8, 0), (8, 1), (None, 1), (9, None)], "doc_id bigint, toxic int"), spark.createDataFrame([], "doc_id bigint, toxic int")):
        found = toxicity.score_texts(edge, labels.withColumn("text", F.lit("x"))).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert toxicity.score_texts(edge.limit(0), labels).count() == 0
