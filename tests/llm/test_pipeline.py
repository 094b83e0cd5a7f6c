import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from lectern.llm import byte_bpe, mixing, quality_rules
from tests.llm import test_minhash_dedup as near


def documents():
    rng = random.Random(21)
    words = lambda n: " ".join(f"{rng.choice(['lor', 'dol', 'sit', 'met'])}{rng.randrange(3000)}" for _ in range(n)) + "."
    passage, rows = words(60), []
    for i in range(90):
        text = words(rng.randrange(30, 120))
        if i % 5 == 0:
            text = f"{text}\n{passage}\n{words(70)}"
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0"))
        if i % 9 == 0:
            rows.append((1000 + i, text.replace("lor", "LOR", 1), "en", "s1"))
    rows += [(2000, "few words", "en", "s1"), (2001, "same words again " * 30, "en", "s2"), (2002, None, None, None), (2003, rows[3][1], "en", "s3"), (2004, "x" * 50, "en", None)]
    return [(k, t, lang, s, len(t or "")) for k, t, lang, s in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    measure = quality_rules.measurer()
    limits = lambda n, wc, sym, dup, rep, lines, stutter, shout: n >= 20 and 100 * rep <= 30 * n and 100 * sym <= 20 * n and 100 * dup <= 50 * lines and 100 * stutter <= 50 * n and wc <= 20 * n and 100 * shout <= 30 * n
    kept = [r for r in rows if limits(*measure(r[1]))]
    classes = near.brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]] == r[0]]
    data = [r[1].encode() for r in kept]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    left = {}
    for r, b in zip(kept, data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left[r[0]] = (bytes(x for x, g in zip(b, gone) if not g).decode(), r[3])
    assert sum(len(t) for t, _ in left.values()) < sum(map(len, data))

    codec = byte_bpe.codec()
    for r in got:
        ids = codec.encode(left[r.doc_id][0])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id][0].encode()).hexdigest()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, (t, _) in left.items()}
    per, taken = defaultdict(int), defaultdict(int)
    for k, (_, s) in left.items():
        per[s] += size[k]
    copies = Counter(r.doc_id for r in got)
    for k, n in copies.items():
        taken[left[k][1]] += n * size[k]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([per[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], sum(per.values()))
    for s, g in zip(order, goal):
        assert abs(taken[s] - g) <= max(size.values())
    assert max(copies.values()) <= 3


NAMES = ("key", "row", "cls", "_cls", "_class", "_id", "id", "dk", "dl", "z", "runs", "kept", "n_words", "failed_bits", "_row", "_copies", "copies", "size", "taken", "target", "_0", "_text", "_key", "bucket")


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    schema = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{c}` string' for c in NAMES)}"
    docs = spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in NAMES)) for r in documents()[:40]], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES] and got, name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in got for c in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(got)


def test_stages_keep_columns_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def chained(plan: str) -> bool:
    """Whether a Python step of a plan's tree reads another one with no exchange between them: two workers a task."""
    above: list[tuple[int, str]] = []
    for line in plan.splitlines():
        if not (m := re.match(r"([\s:|+-]*)(?:\*\(\d+\) )?(\w+)", line)):
            continue
        above = [x for x in above if x[0] < len(m[1])]
        below = [name for _, name in above]
        last = max((i for i, name in enumerate(below) if name.endswith("Exchange")), default=-1)
        if m[2] == "MapInArrow" and m[2] in below[last + 1 :]:
            return True
        above.append((len(m[1]), m[2]))
    return False


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Executors keep every worker that any task had, so a second one a task counts in all later stages."""
    from pyspark import SparkContext

    import corpus_pipeline

    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    twice = docs.limit(9).mapInArrow(lambda b: b, docs.schema).mapInArrow(lambda b: b, docs.schema)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert chained(plan(twice)) and not chained(plan(docs.mapInArrow(lambda b: b, docs.schema).repartition(3).mapInArrow(lambda b: b, docs.schema)))

    plans, frame = [], type(docs)
    written, listed = frame.checkpoint, SparkContext.parallelize
    monkeypatch.setattr(frame, "checkpoint", lambda self, eager=True: plans.append(plan(self)) or written(self, eager))
    rows = []  # lists that become tables go through Python workers of another kind, kept beside those of the steps
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, c, *n: rows.extend(c := list(c)) or listed(self, c, *n))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        plans.append(plan(out))
        assert not [p for p in plans if chained(p)], name
        assert not rows, name
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = written(out, True)
    assert sum("MapInArrow" in p for p in plans) > 5
