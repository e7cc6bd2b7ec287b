"""The pipeline's stages against brute force, on the smallest table."""

import collections

import corpus_pipeline
from stratarisk.llm import common

from test_llm_ops import late_lines, linked_components, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = common.materialize(stage(spark, docs, SF), "test-stage")
        seen[name] = docs
        if name == "packing":
            whole = collections.Counter()
            for r in docs.collect():
                whole[(r["doc_id"], r["doc_tokens"])] += r["length"]
            assert sorted(i for i, _ in whole) == sorted(i for i, _ in before) and all(n == v for (_, n), v in whole.items())
            continue
        assert docs.columns == columns
        after = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "line_dedup":
            late, counted = late_lines(before)
            assert after == sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in late[i])) for i, t in before if counted[i] != late[i] or not counted[i])
        elif name == "ngram_jaccard_join":
            assert [i for i, _ in after] == sorted(i for i, n, c in linked_components(before) if not n or i == c)
        elif name == "benchmark_decontamination":
            items = [" ".join(tokens(r["text"])) for r in common.table(spark, SF, "benchmark").collect()]
            leaks = {i for i, t in before if any(x in " ".join(tokens(t)) for x in items)}
            assert leaks and not leaks & {i for i, _ in after} and len(after) >= len(before) - len(leaks) - 1
        else:
            bad = {r["doc_id"] for r in common.table(spark, SF, "labels").where("quality = 0").collect()}
            good = {r["doc_id"] for r in common.table(spark, SF, "labels").where("quality = 1").collect()}
            left = {i for i, _ in after}
            assert len(good & left) >= 0.95 * len(good) and len(bad & left) <= 0.5 * len(bad)
    assert corpus_pipeline.run(spark, SF).count() == seen["packing"].count()
