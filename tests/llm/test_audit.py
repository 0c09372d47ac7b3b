"""The filter audit against applying every order to every document."""

import re
from itertools import permutations

from trackloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, good int, n long, kept long"
LABELS = "doc_id long, quality int, toxic int, good int"


def failing(text, doc, others):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if doc is not None and any(i is not None and i < doc and t == text for i, t in others) or doc is None and any(i is not None and t == text for i, t in others):
        out.add("E")
    return out


def brute(rows, labels):
    texts = [(r[0], r[1] or "") for r in rows]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = [failing(t, i, texts) for i, t in texts]
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(p, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(p), step] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone if x[0] is not None), sum(x[0] in toxic for x in gone if x[0] is not None),
                ]
        for (q, order, step), v in out.items():
            if q == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, 9) for x in labels], LABELS)).collect()
    return {(r[0], r[1], r[2]): list(r[3:]) for r in got}


def test_audit(spark, texts):
    long = " ".join(f"w{i}" for i in range(220))
    more = [*texts, long, long, long + " #", long.upper(), "a b " * 150, "A " * 3, long + "\x85x", "é" * 98 + "AB", "é" * 97 + "ABC"]
    rows = [(3 * i, t, ("s1", None, "s2")[i % 3]) for i, t in enumerate(more)]
    rows += [rows[9], rows[9], (2, more[9], "s1"), (None, more[9], "s2"), (None, "only here", "s2"), (None, "only here", "s2"), (1000, "", ""), (1000, "", "s1")]
    labels = [(3 * i, i % 2, (i % 3 == 0) * 1) for i in range(20)] + [(27, 1, None), (27, 0, 1), (None, 1, 1), (99_999, 1, 1), (2, None, None)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_hot_text_and_part(spark):
    rows = [(i, "same text", "hot" if i % 3 else "cold") for i in range(90)] + [(500 + i, f"text {i}", "hot") for i in range(30)]
    assert audited(spark, rows, [(i, 1, 0) for i in range(0, 500, 5)]) == brute(rows, [(i, 1, 0) for i in range(0, 500, 5)])


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, None, None)], [])) == 600


def test_matrices():
    m = filter_audit.matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    assert ((m["kept"] + m["removed"]).max(), m["removed"].sum(axis=1)[1]) == (1, 120)
    # what all filters remove over all orders is 120 times what fails any
    by_order = m["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (by_order[1:] == 1).all() and (by_order[0] == 0).all()
