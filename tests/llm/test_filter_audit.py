"""The audit against a walk of every document through every order."""

import itertools
import random
import re
from collections import Counter

from starledger.llm import filter_audit

from .fixtures import documents, text

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, labels):
    """rows: (doc_id, source, text); labels: {doc_id: (quality, toxic)}."""
    smallest = {}
    for key, _, value in rows:
        smallest[value or ""] = min(smallest.get(value or "", key), key)
    total = Counter()
    for key, source, value in rows:
        value, part = value or "", source or ""
        words = WORD.findall(value)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", value)) > 2 * len(value),
            "D": bool(set(value) & set("#$%&*|")), "E": smallest[value] < key,
        }
        good, toxic = (x == 1 for x in labels.get(key, (None, None)))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                at = (part, "".join(order), step)
                out = failed[letter] and not gone
                total.update({(*at, "redundant"): int(failed[letter] and gone), (*at, "removed"): int(out), (*at, "good_lost"): int(out and good), (*at, "toxic_lost"): int(out and toxic)})
                gone |= failed[letter]
                total.update({(*at, "kept"): int(not gone), (*at, "unique_fails"): int(failed[letter] and sum(failed.values()) == 1)})
                total[part, letter, "shapley"] += out
    return {(*at, name, n) for (*at, name), n in total.items() if name != "shapley"}, {(part, letter): n for (part, letter, name), n in ((k, v) for k, v in total.items() if len(k) == 3)}


def test_audit_equals_walking(spark):
    rng = random.Random(3)
    base = documents(7, 6) + [(500 + i, text(rng, 250) + rng.choice(["", " #", " A B C D E F G H I J K L M N O P Q R S T U V W X Y Z " * 2])) for i in range(12)]
    base += [(550, text(rng, 60_000)), (551, "é🎈Z" * 50_000)]  # very long ones
    base += [(600 + i, base[rng.randrange(len(base))][1]) for i in range(10)]
    rows = [(k, rng.choice(["s1", "s2", "", None]), t) for k, t in base]
    rows += [rows[0], (600, "s2", "twice"), (600, "s2", "twice"), (600, "s1", "twice"), (601, "s1", "twice")]  # repeated rows
    labels = {k: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k, _, _ in rows[::2]}
    docs = spark.createDataFrame([(k, s, t, 1, "x") for k, s, t in rows], "doc_id long, source string, text string, n int, part string").repartition(3)
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    each, shapley = plain(rows, labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    assert {(r.part, r.filter_order, r.step, c, r[c]) for r in got for c in names} == each
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)
    assert len(got) == 600 * len({s or "" for _, s, _ in rows})


def test_edges_are_eighty_for_a_part(spark):
    counts = spark.createDataFrame([("p", 5, True, False, 7), ("q", 0, False, False, 1)], "part string, failed int, good boolean, toxic boolean, n long")
    assert sorted(map(tuple, filter_audit.edges(counts).groupBy("part").count().collect())) == [("p", 80), ("q", 80)]


def test_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "s", "x"), (None, "s", "x"), (1, "s", "x"), (None, None, None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    first = {(r.part, r.filter_order[0]): r for r in filter_audit.audit(docs, labels).where("step = 1").collect()}
    assert first["s", "E"].removed == 2 and first["", "E"].removed == 0 and first["s", "A"].good_lost == 1
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost > 0").count() == 0
