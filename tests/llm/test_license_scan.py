from __future__ import annotations

import re
from functools import lru_cache

import pytest

from stationlake.llm import license_scan


@lru_cache(None)
def template_set(text):
    return frozenset(license_scan.template_bigrams(text))


def brute_force(text, threshold=0.8):
    plain = re.sub(r"[^\w\n]+|_+", " ", text.lower())
    plain = re.sub(" +", " ", plain)
    parts = {*plain.split("\n")}
    if "\n" in plain:
        parts |= {p for p in re.split(r"\n[ \n]*\n", plain) if "\n" in p} | {plain}
    best = {}
    for part in parts:
        words = part.split()
        a = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
        dice = []
        for name, template in license_scan.TEMPLATES:
            b = template_set(template)
            if a:
                dice.append((2 * len(a & b) / (len(a) + len(b)), name))
        top = max((d for d, _ in dice), default=0)
        for d, name in dice:
            if d == top >= threshold:
                best.setdefault(name, []).append((d, part))
    return {name: (max(d for d, _ in found), len({p for _, p in found})) for name, found in best.items()}


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, {(r["doc_id"], r["license"]): (r["dice"], r["n_parts"]) for r in license_scan.scan(docs).collect()}


def test_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    notices = [t for _, t in license_scan.NOTICES]
    texts = [r["text"] or "" for r in rows] + notices + [f"Title\n\n{n}\nmore\n\nend of it" for n in notices] + [n.upper().replace(" ", "  ") for n in notices]
    _, got = scan(spark, texts)
    want = {(i, name): v for i, t in enumerate(texts) for name, v in brute_force(t).items()}
    assert got.keys() == want.keys() and len(want) > 40
    for k, (dice, parts) in want.items():
        assert got[k][0] == pytest.approx(dice) and got[k][1] == parts


def test_bounds_keep_every_match():
    for a in range(1, 80):
        for b in range(1, 80):
            low, high = license_scan._bounds(b, 0.8)
            if 2 * min(a, b) / (a + b) >= 0.8:
                assert low <= a <= high


def test_changed_words(spark):
    mit = license_scan.TEMPLATES[3][1]
    words = mit.split()
    few, many = list(words), list(words)
    few[10] = few[40] = "other"
    many[::3] = ["other"] * len(many[::3])
    _, got = scan(spark, [" ".join(few), " ".join(many)])
    assert (0, "MIT") in got and all(k[0] != 1 for k in got)


def test_whole_licenses(spark):
    """Each text as it is, within other text, and with another holder and a few changed words."""
    whole = [t for t in license_scan.TEMPLATES if len(t[1]) > 1400 and t not in license_scan.NOTICES and "\n\n" in t[1]]
    assert {name for name, _ in whole} >= {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"}
    prose = "\n\n".join(f"This page tells of work{i} and of what came of it in the end" for i in range(300))
    texts = [t for _, t in whole] + [f"{prose}\n\n{t}\n\n{prose}" for _, t in whole]
    texts.append(re.sub("Regents of the University of California|REGENTS|University", "Example Ltd", next(t for n, t in whole if n == "BSD-3-Clause")))
    _, got = scan(spark, texts)
    for i, (name, _) in enumerate(whole * 2):
        assert got[i, name][0] == 1
    assert (len(texts) - 1, "BSD-3-Clause") in got
    assert brute_force(texts[-1]).keys() == {name for i, name in got if i == len(texts) - 1}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "Licensed under CC BY 4.0.", "c"), (3, "Licensed under CC BY 4.0.", "c"), (4, "x " * 200_000, "d"), (None, "Licensed under CC BY 4.0.", "e")],
        "doc_id long, text string, plain string",
    ).selectExpr("*", "1 as template", "2 as bigram", "3 as words")
    got = [(r["doc_id"], r["license"], r["n_parts"]) for r in license_scan.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, "CC-BY-4.0", 1), (None, "CC-BY-4.0", 1)], key=str)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_native(spark, sf_dir):
    plan = license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|InPandas|Cartesian|NestedLoop", plan)
