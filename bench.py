"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

HEADLINES = (
    "tokenize",
    "query_tokens",
    "fixed_windows",
    "carry_forward_section",
    "detect_section_title",
    "split_doc_sections",
    "merge_short_sections",
    "split_markdown_sections",
    "extract_refs",
    "pack_pages",
    "narrative_windows",
    "extract_symbols",
    "assign_chunk_ids",
    "document_frequency",
    "tf_weights",
    "lexical_search",
    "dense_search",
    "hybrid_search",
    "source_quota",
    "retrieve",
    "merge_result_sets",
    "rerank_workflow",
    "resolve_refs",
    "graph_expand",
    "choose_workflow",
    "question_features",
    "match_rules",
    "context_block",
    "parse_responses",
    "mrr",
)


def main() -> None:
    from granary import catalog
    from granary.runtime import get_spark

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = get_spark(
        "bench",
        cpus,
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    # JVM and Python worker start are not part of any query.
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    times: dict[str, float] = {}
    for name in only or HEADLINES:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
