import random

import duckdb
import pytest

from starledger.llm import licenses, line_dedup

from .fixtures import frame


def pages():
    rows = []
    for i in range(60):
        lines = [f"content {i} a", f"content {i} b", ""]
        lines += ["Menu | Home"] * (i % 2) + ["  Footer © "] * (i % 5 != 0) + ["rare"] * (i % 20 == 0)
        rows.append((i, f"src{i % 2}", "\n".join(lines)))
    rows += [(100, "src0", "copy line\nanother copied line")] * 1 + [(200 + i, "src0", "copy line\nanother copied line") for i in range(40)]
    rows += [(300, None, "x\ny"), (301, "tiny", "Menu | Home"), (302, "src1", None), (303, "src1", ""), (304, "src1", "  \n\n"), (305, "src1", "Footer ©"), (None, "src1", "Footer ©\nkept")]
    return rows


def test_lines_equal_the_sql(spark):
    df = spark.createDataFrame([(*r, 1, "h", "k") for r in pages()], "doc_id long, source string, text string, n_lines int, host string, _KEPT string")
    out = line_dedup.drop_boilerplate(df)
    assert out.columns == ["doc_id", "source", "text", "host", "_KEPT", "n_lines", "n_dropped"]
    got = sorted((tuple(r[c] for c in ("doc_id", "source", "text", "n_lines", "n_dropped")) for r in out.collect()), key=str)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", pages())
    assert got == sorted(con.sql(line_dedup.oracle()).fetchall(), key=str)
    by = {r[0]: r for r in got}
    assert by[1][2] == "content 1 a\ncontent 1 b\n" and by[0][2].endswith("rare") and by[205][2].startswith("copy line") and by[305][2] == "" and by[302][2:] == (None, 0, 0)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(pages(), "doc_id long, source string, text string")
    first = sorted(map(str, line_dedup.drop_boilerplate(df).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(str, line_dedup.drop_boilerplate(df).collect())) == first


def brute(rows, templates, least=0.8, k=5):
    out = {}
    for i, t in rows:
        have = set(licenses._shingles(licenses._words(t or ""), k))
        for j, (_, x) in enumerate(templates):
            want = set(licenses._shingles(licenses._words(x), k))
            if want and len(have & want) >= least * len(want):
                out[i, j] = len(have & want) / len(want)
    return out


def license_rows():
    filler = "the quick brown fox jumps over a lazy dog under this version of the terms without charge "
    rows = [(i, filler * (i % 7) + t + " " + filler * (i % 3)) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + i, filler * 2 + t.upper().replace(" ", "  \n*** ")) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    mit = licenses.TEMPLATES[2][1].split()
    rows += [(200, " ".join(mit[:-4])), (201, " ".join(mit[:8])), (202, ""), (203, None), (204, "license"), (205, filler * 300), (206, "Released under the MIT License."), (206, "Released under the MIT License.")]
    return rows


def test_licenses_equal_brute_force(spark):
    rows = license_rows()
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in licenses.license_hits(frame(spark, rows)).collect()}
    assert got == brute(rows, licenses.TEMPLATES)
    assert licenses.license_hits(frame(spark, rows).limit(0)).count() == 0
    assert licenses.license_hits(frame(spark, rows), []).count() == 0


def test_templates_in_blocks_and_long_texts(spark, monkeypatch):
    rows = license_rows()[:20] + [(300, "filler words here " * 100_000 + licenses.TEMPLATES[16][1] + " tail" * 1000)]
    whole = sorted(map(tuple, licenses.license_hits(frame(spark, rows)).collect()))
    assert {(r[0], r[2]): r[3] for r in whole} == brute(rows, licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 5)
    assert sorted(map(tuple, licenses.license_hits(frame(spark, rows)).collect())) == whole


def test_recall_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], licenses.TEMPLATES)
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in licenses.license_hits(docs).collect()}
    assert got == expected and expected


def test_each_shingle_of_a_template_matches_the_pattern():
    import re

    for templates in (licenses.TEMPLATES, [("x", "One"), ("y", "one two three")]):
        pattern = re.compile(licenses.hitting_pattern(templates, 5))
        for _, t in templates:
            for s in licenses._shingles(licenses._words(t), 5):
                assert pattern.search(f"é{s.upper().replace(' ', '* ')}ß") and pattern.search(s)
        assert not pattern.search("nothing of that kind, underground")


@pytest.mark.parametrize("least", [8, 16, 32, 64])
def test_bands_retrieve_nearly_always(least):
    """The lowest similarity of a window to a template it holds to 0.8, for each length class."""
    low = 1.0
    for words in range(least // 2 + 1 if least > 8 else 5, least + 1):
        n, m = words - 4, least + least // 4 - 4
        held = -(-8 * n // 10)
        low = min(low, held / (m + n - held))
    assert 1 - (1 - low) ** licenses.BANDS > 0.9999


def test_whole_license_texts_from_a_folder(spark, tmp_path):
    """Texts of thousands of words are found in longer documents, also with a tenth of their words in other places changed."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "licens copyr permit distrib warrant work sourc".split() for b in "e ed es ing ion or able".split()]
    whole = {name: " ".join(rng.choice(vocabulary) for _ in range(n)) for name, n in (("LONG-1.0", 5600), ("LONG-2.0", 2900), ("SHORT-1.0", 40))}
    for name, text_ in whole.items():
        (tmp_path / name).write_text(text_)
    templates = licenses.templates_of(spark, str(tmp_path))
    assert templates == sorted(whole.items())
    words = whole["LONG-1.0"].split()
    for i in range(0, len(words), 60):
        words[i] = "other"
    docs = [(1, "before " * 50 + whole["LONG-1.0"] + " after" * 70), (2, " ".join(words)), (3, whole["LONG-2.0"][: len(whole["LONG-2.0"]) // 2]), (4, whole["SHORT-1.0"].upper() + "\n" + whole["LONG-2.0"])]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.license_hits(frame(spark, docs), licenses.TEMPLATES + templates).collect()}
    assert set(got) == {(1, "LONG-1.0"), (2, "LONG-1.0"), (4, "SHORT-1.0"), (4, "LONG-2.0")}
    assert got[1, "LONG-1.0"] == 1 and 0.8 <= got[2, "LONG-1.0"] < 1
