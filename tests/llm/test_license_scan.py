import re

from lectern.llm import license_scan as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    back = lambda i: words[i] if i >= 0 else ""
    denied = lambda i: back(i - 1) in L.DENIED or (back(i - 1) in L.ARTICLES and back(i - 2) in L.DENIED)
    own = lambda p: [i for i in at(p) if not denied(i) and not any(i in at(q) for q in L.PHRASES if q != p and q.startswith(p + " "))]
    labels, scores = {b for b, p in L.BASE if at(p)}, [0.5 if any(at(p) for _, p in L.BASE) else 0.0]
    for label, keys in L.TEMPLATES:
        if any(all(any(abs(t - off - s) <= L.SLACK for t in at(p)) for p, off in keys[1:]) for s in own(keys[0][0])):
            labels.add(label)
            scores.append(0.5 + min(24, sum(len(p.split()) for p, _ in keys)) / 48)
    base = sorted(i for _, p in L.BASE for i in at(p))
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({b for b, p in L.BASE if at(p)})), ",".join(sorted(labels)), max(scores)


NOTICES = [notice for _, notice, _ in L.NOTICES]
TEXTS = [
    None, "", "cc by", "CC-BY CC BY-NC 4.0 cc cc by by", "All rights reserved. ALL RIGHTS RESERVED", "general public\nlicense v3, GNU Lesser General Public License",
    "Released under the MIT License.", "rights reserved all", "éall rights reserved", "all é rights reserved", "Licensed under the Apache License, Version 2.0",
    "by " * 5000 + "cc by", "all rights " * 400 + "reserved", *L.PHRASES, " ".join(L.PHRASES) * 3, *NOTICES, *(n.replace(" of ", " of one or another word or two or three of ") for n in NOTICES),
    *(" ".join(n.split()[: len(n.split()) // 2]) for n in NOTICES), "word " * 50_000 + NOTICES[0] + " word" * 50_000, "not the MIT License", "nor MIT license, neither a BSD license", "not MIT; but the MIT license",
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "a", 0, "b") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "a", 0, "b")], "doc_id long, text string, labels string, words int, held string")
    got = sorted(tuple(r) for r in L.license_rows(docs).collect())
    assert got == sorted((i, *brute(t)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])


def test_names_versions_and_terms_are_told_apart(spark):
    cases = {
        "Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License": "cc-by-nc-nd", "Creative Commons Attribution 4.0 International License": "cc-by",
        "Mozilla Public License 1.1": "mpl-1.1", "Mozilla Public License, version 2.0": "mpl-2.0", "Mozilla Public License": "mpl", "CC BY-NC-SA 3.0": "cc-by,cc-by-nc-sa",
        "not the MIT License; apache license is older than version 2.0": "", "Apache License, Version 2.0": "apache-2.0", "GNU General Public License version 3": "gpl,gpl-3",
        "Redistribution and use in source and binary forms": "", NOTICES[1]: "bsd", NOTICES[0]: "mit", NOTICES[7]: "boost",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in L.license_rows(docs).collect()} == dict(enumerate(cases.values()))


def test_plan_is_native(spark):
    plan = L.license_rows(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert L.license_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_twin_equals_brute_force():
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})  # noqa: F841
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({L.ORACLE})").fetchall())
    assert got == sorted((i, *brute(t)) for i, t in enumerate(TEXTS))
