"""Each stage of the pipeline against a plain version on the stage's own input, and the whole run."""

import pytest

import corpus_pipeline as pipeline
from starledger.llm import toxicity
from starledger.llm.common import table

from .test_decontam import brute as contaminated
from .test_jaccard import brute as components


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    assert all(a.columns == list(pipeline.COLUMNS) for n, (_, a) in stages.items() if n != "packing")


def test_toxic_documents_go(stages, spark, sf_dir):
    before, after = stages["toxicity"]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(before, table(spark, sf_dir, "labels")).collect()}
    assert ids(after) == sorted(i for i, p in scores.items() if not p) and len(ids(after)) > 0.8 * before.count()


def test_lines_go_and_documents_stay(stages):
    before, after = stages["line_dedup"]
    old = {r["doc_id"]: r for r in before.collect()}
    hosts, pages = {}, {}
    for r in old.values():
        pages.setdefault(r["source"], set()).add(r["text"])
    for host, held in pages.items():
        for t in held:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                hosts.setdefault(host, {}).setdefault(line, set()).add(t)
    drop = {h: {x for x, t in lines.items() if len(t) >= 5 and len(t) > 0.1 * len(pages[h])} for h, lines in hosts.items()}
    for r in after.collect():
        kept = "\n".join(x for x in old[r["doc_id"]]["text"].split("\n") if x.strip(" ") not in drop.get(r["source"], ()))
        assert r["text"] == kept and (kept == old[r["doc_id"]]["text"] or r["n_chars"] == len(kept))
    assert ids(after) == ids(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    assert ids(after) == [i for i, _, c in components(texts(before)) if i == c]


def test_contaminated_documents_go(stages, spark, sf_dir):
    before, after = stages["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {i for i, _ in contaminated(texts(before), items)}
    assert ids(after) == [i for i in ids(before) if i not in hit]


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    assert sorted({r["doc_id"] for r in after.collect()}) == ids(before)


def test_run(spark, sf_dir, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, stages["packing"][1].select("doc_id", "doc_tokens").distinct().collect()))
    assert set(columns) <= set(stages["packing"][1].columns)


def test_every_operator_has_its_query():
    from starledger.llm import queries

    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"] and set(queries.oracle_sql()) <= set(names)


def test_near_copies_of_an_article_keep_its_lines(spark, sf_dir):
    import random

    from .fixtures import text

    rng = random.Random(5)
    lines = [text(rng, 20) for _ in range(10)]
    rows = [(i, f"{text(rng, 40)}\nSite footer", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "\n".join([*lines, f"{text(rng, 2)} copy {i}", "Site footer"]), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.drop_boilerplate(spark, docs, sf_dir).collect()}
    assert got == {i: t.removesuffix("\nSite footer") for i, t, *_ in rows}


def test_one_row_of_each_component_stays_with_repeated_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    whole, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(1, whole), (1, whole), (2, near), (2, "a lone text of quite other words here"), (None, near), (3, ""), (3, ""), (4, "six words that stand here once"), (None, "text without an id that is alone"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.keep_one_of_group(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([rows[0], *rows[3:4], *rows[5:]], key=str)


LONG = " ".join(f"word{i % 997} and{i}" for i in range(60_000))
EDGES = [
    [],
    [(None, None, None, None, None)] * 3,
    [(1, "", "en", "s", 0), (2, None, "en", None, None), (None, "some words without an id", None, "s", 5), (3, " \n\t ", "de", "", 4)],
    [(1, LONG, "en", "s", len(LONG)), (2, LONG + " more", "en", "s", len(LONG) + 5), (3, "a short text of its own", "en", "t", 23), (4, "a short text of its own", "en", "t", 23)],
]


@pytest.mark.parametrize("rows", EDGES, ids=["empty", "nulls", "blank", "long"])
@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_edges_of_each_stage(spark, sf_dir, name, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int")
    got = dict(pipeline.STAGES)[name](spark, docs, sf_dir).collect()
    if name == "packing":
        ids_in, ids_out = ({str(r[0]) for r in rows}, {str(r["doc_id"]) for r in got})
        assert ids_in == ids_out
        return
    plain = {"toxicity": rows, "line_dedup": rows, "benchmark_decontamination": rows}.get(name)
    if plain is None:  # one of each group of near copies; texts without words all stay
        plain = rows if rows is not EDGES[3] else [rows[0], rows[2]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain))
