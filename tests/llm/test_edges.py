"""NULLs, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stockwright.llm import bpe, chat, language, lm, mixing, neighbours, quality, secrets, simhash, suffixes
from stockwright.llm.queries import VOCABULARY

CLASHING = ["fp", "key", "row", "word", "words", "size", "n", "base", "spans", "bucket", "places", "a", "b", "_at", "_id", "rank", "block", "c", "range",
            "root", "node", "copies", "ids", "held_out", "score", "target", "place", "rare", "times", "label", "position", "_keep_id", "_copy", "t", "lang_pred"]
SHA_EMPTY = hashlib.sha256(b"").hexdigest()
LONG = "abc déf " * 60_000
RUN = "x" * 300_000
ROWS = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, LONG, "en", None), (5, "the same words are here", "en", "s"),
        (5, "the same words are here", "en", "s"), (None, "no id at all", None, None), (7, "the same words are here", "de", "s"), (8, RUN, "de", "t"),
        (9, "123 456 !!", "fr", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.withColumns({c: F.lit(f"{c}?") for c in CLASHING})


DOCUMENT_OPERATORS = {
    "simhash": simhash.near_duplicates, "secrets": secrets.report, "mixing": mixing.mix, "suffixes": suffixes.repeated_passages,
    "language": language.identify, "bpe": lambda d: bpe.digests(d, VOCABULARY), "quality": quality.judged, "lm": lm.score_texts,
}
ROW_OPERATORS = {"labelled": language.labelled, "keep_one": simhash.keep_one, "redact": secrets.redact, "arranged": mixing.arranged}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_every_row_has_a_result(docs, name):
    found = DOCUMENT_OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    by = {r["doc_id"]: r for r in found}
    if name == "simhash":
        assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16
        assert by[5]["component_id"] == by[7]["component_id"] == 5 and by[None]["component_id"] is None
    if name == "secrets":
        assert all(r["n_assign"] == r["n_access"] == r["n_hex"] == 0 and r["spans"] == "" and r["base_sha256"] == SHA_EMPTY for r in found)
    if name == "mixing":
        assert by[1]["taken"] == by[2]["taken"] == 0 and by[4]["size"] == 120_000
        assert all(r["taken"] <= 3 * r["size"] for r in found)
    if name == "suffixes":
        assert (by[1]["n_bytes"], by[1]["n_removed"], by[1]["kept_sha256"]) == (0, 0, SHA_EMPTY)
        assert by[4]["n_removed"] == by[4]["n_bytes"] and by[8]["n_removed"] == 300_000 and by[8]["n_spans"] == 1
        assert by[5]["n_removed"] == 0 and by[5]["kept_sha256"] == hashlib.sha256(b"the same words are here").hexdigest()
    if name == "language":
        assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 9))
        assert all(0 <= r["score"] <= 1 for r in found)
    if name == "bpe":
        assert by[1]["n_tokens"] == 0 and by[1]["ids_sha256"] == SHA_EMPTY
        assert by[4]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest() and by[8]["decoded_sha256"] == hashlib.sha256(RUN.encode()).hexdigest()
    if name == "quality":
        assert by[1]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
        assert by[4]["n_repeat_words"] == by[4]["n_words"] == 120_000 and by[8]["word_chars"] == 300_000
    if name == "lm":
        assert by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[4]["n_tokens"] == 120_001
        assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in found)


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_empty_table_gives_no_row(docs, name):
    assert DOCUMENT_OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ROW_OPERATORS)
def test_columns_stay_and_empty_tables_pass(docs, name):
    assert ROW_OPERATORS[name](docs.limit(0)).count() == 0
    found = ROW_OPERATORS[name](docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r["key"] == "key?" and r["_at"] == "_at?" for r in rows)
    if name == "labelled":
        assert {r["doc_id"] for r in rows} == {4, 5, 7, 8, None}
    if name == "keep_one":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, [1, 4, 5, None, 8, 9]))
    if name == "redact":
        assert [r["text"] for r in rows if r["doc_id"] == 1] == [None] and len(rows) == len(ROWS)


def test_one_document_of_each_component_stays(spark):
    text = lambda k: " ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:6] for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (3, text(3)), (3, text(4)), (3, text(4)), (5, text(5)), (None, text(5)),
            (3, text(6)), (2, text(6)), (8, text(7)), (9, text(7))]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    names = {text(k): k for k in range(8)}
    assert sorted((names[r["text"]], r["doc_id"]) for r in found) == [(0, None), (1, None), (2, None), (3, 3), (4, 3), (5, 5), (6, 2), (7, 8)]


def test_rows_without_an_id_are_mixed_as_often_as_taken(spark):
    rows = [(None, f"{'a' if k % 2 else 'b'}{k} one two three", "en", "t" if k % 8 else "s") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    sources = dict(zip([r[1] for r in rows], [r[3] for r in rows]))
    sizes = {40: 0, 280: 0}  # words of sources s and t
    for r in mixing.mix(docs).collect():
        sizes[r["source_size"]] += int(r["taken"] / r["size"] + 0.5)
    found = [r["text"] for r in mixing.arranged(docs).collect()]
    assert [sum(sources[t] == s for t in found) for s in "st"] == [sizes[40], sizes[280]]
    assert max(map(found.count, found)) <= 3


def test_a_mix_comes_in_training_order(spark):
    rows = [(k, " ".join(["word"] * (k % 7)), "en", "uvw"[k % 3]) for k in range(400)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    turns = [r["position"] for r in found if r["taken"] > 0]
    assert len(found) == 400 and 0 < len(turns) < 400 and turns == sorted(turns)
    assert all(r["taken"] == 0 and r["position"] is None for r in found[len(turns):])
    places = {s: [i for i, r in enumerate(found[: len(turns)]) if rows[r["doc_id"]][3] == s] for s in "uvw"}
    assert all(p[0] < len(turns) / 4 and p[-1] > len(turns) / 4 for p in places.values())  # sources are interleaved


def test_a_task_that_reads_chats_back_has_one_worker(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "a word")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.report(table, VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one before the turns are dealt, one after


def test_only_nulls(spark):
    nothing = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id bigint, text string, lang string, source string")
    for name, operator in DOCUMENT_OPERATORS.items():
        assert operator(nothing).count() == 3, name


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, []), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (40, [1.0]), (2, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(0) for c in CLASHING})
    found = {}
    for r in neighbours.nearest(table, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {0: [(1, 2.0), (2, 2.0), (2, 2.0)], 20: [(1, 1.0), (2, 1.0), (2, 1.0)]}
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 3")).count() == 0


def test_chats(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (None, 0, None, "</s>"), (2, None, "user", ""), (2, 1, "assistant", "<|end|>\\"), (2, 1, "assistant", "<|end|>\\")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(0) for c in CLASHING})
    found = {r["conv_id"]: r for r in chat.report(table, VOCABULARY).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha("user\nhi\nassistant\n\n") and found[1]["loss_chars"] == 0
    assert found[None]["turns_sha256"] == sha("\n</s>\n") and found[2]["n_turns"] == 3
    assert found[2]["loss_sha256"] == sha("<|end|>\\<|end|>\\") and found[2]["loss_chars"] == 16
    assert chat.report(table.limit(0), VOCABULARY).count() == 0
