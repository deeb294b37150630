"""Filter interaction audit against brute force over documents, orders and steps."""

import itertools
import re
from collections import Counter

import numpy as np

from tandem.llm.filter_audit import FIELDS, PackedCounters, audit_orders, failure_masks

DOCS = "doc_id long, text string, lang string, part string, mask int, n long"
LABELS = "doc_id long, quality int, toxic int, good string"


def brute(docs, labels):
    texts = [t or "" for _, t, _ in docs]
    flags = {}
    for d, q, x in labels:
        g, t = flags.get(d, (False, False))
        flags[d] = (g or q == 1, t or x == 1)
    rows = []
    for (d, _, lang), t in zip(docs, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d is not None and any(o is not None and o < d and u == t for (o, _, _), u in zip(docs, texts))}
        rows.append((lang or "", fails, *(flags.get(d, (False, False)) if d is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                c = Counter()
                for p, fails, good, toxic in rows:
                    if p != part:
                        continue
                    gone = any(fails[x] for x in order[:step - 1])
                    removed = fails[letter] and not gone
                    c["kept"] += not gone and not fails[letter]
                    c["removed"] += removed
                    c["redundant"] += fails[letter] and gone
                    c["unique_fails"] += fails[letter] and sum(fails.values()) == 1
                    c["good_lost"] += removed and good
                    c["toxic_lost"] += removed and toxic
                shapley[letter] += c["removed"]
                out[part, "".join(order), step] = [c[f] for f in FIELDS]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def documents():
    rng = np.random.default_rng(0)
    out = []
    for i in range(60):
        n = int(rng.choice([20, 99, 100, 101, 180]))
        kinds = int(rng.choice([max(1, n // 2), n * 4 // 5, n * 3]))
        words = [f"w{x}" for x in rng.integers(0, kinds, n)]
        if i % 3 == 0:
            words = [w.upper() for w in words]
        if i % 4 == 0:
            words[0] = rng.choice(list("#$%&*|")) + words[0]
        out.append((i, rng.choice([" ", "\n", "\x0b \t", "  "]).join(words), ["en", "fr", None][i % 3]))
    out += [(100 + i, out[i][1], "en") for i in range(0, 60, 2)]        # copies
    out += [(200, None, "de"), (201, "", "de"), (202, " \n", "de"), (3, out[3][1], "en"), (3, out[3][1], "en"), (3, "other text", "fr"),
            (None, out[5][1], "en"), (None, out[5][1], "en"), (-1, out[5][1], None), (300, "x " * 200000, "de"), (301, "É\U0001F600 " * 120, "de")]
    return out


def labelled():
    return [(i, i % 2, int(i % 5 == 0)) for i in range(0, 130, 2)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (9999, 1, 1), (4, None, None)]


def run(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS).repartition(4)
    lab = spark.createDataFrame([(*r, "z") for r in labels], LABELS)
    got = audit_orders(failure_masks(df), lab)
    assert got.columns == ["part", "filter_order", "step", *FIELDS, "shapley"]
    rows = got.collect()
    out = {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] + [r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark):
    docs = documents()
    assert run(spark, docs, labelled()) == brute(docs, labelled())


def test_empty_tables(spark):
    assert run(spark, [], labelled()) == {}
    docs = documents()[:5]
    assert run(spark, docs, []) == brute(docs, [])


def test_many_equal_rows(spark):
    docs = [(7, "a b c", "en")] * 500 + [(i, "a b c", "en") for i in range(8, 300)] + [(None, "a b c", "en")] * 200
    got = run(spark, docs, [(7, 1, 1)])
    assert got["en", "EABCD", 1][:2] == [700, 292] and got["en", "ABCDE", 1][:2] == [0, 992]
    assert got["en", "ABCDE", 1][4:6] == [500, 500]


def test_fields_hold_large_counts():
    """Counts near 2^62 in every mask neither overflow a field nor touch its neighbours."""
    packed = PackedCounters(3)
    n = 2 ** 62 // 8
    total = sum(packed.of[m, True, False] * n for m in range(8))
    got = packed.unpack(total)
    assert (got[..., 0] + got[..., 1] + got[..., 2] <= 8 * n).all()
    for o, order in enumerate(packed.orders):
        assert list(got[o, :, 0]) == [4 * n, 2 * n, n] and list(got[o, :, 1]) == [4 * n, 2 * n, n]
        assert list(got[o, :, 2]) == [0, 2 * n, 3 * n] and (got[o, :, 3] == n).all() and not got[o, :, 5].any()
