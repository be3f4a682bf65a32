"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from colloquy import queries as own

QUERIES = (
    "a5_turn_runs", "a9_subject_paths", "a10_top_values", "j3_evidence_trace", "j4_pair_cooccurrence", "j10_anchored_windows", "w4_sliding_windows", "w4_event_windows", "c2_window_chunks", "c4_evidence_index",
    "g1_nodes", "g2_edges", "d18_label_assignments", "g10_evidence_bridge", "m1_frequent_questions", "m3_recurring_misconceptions", "m6_strategy_pairs", "m7_content_opportunities", "a1_label_ranking",
    "f2_redaction", "f8_token_estimate", "a11_document_frequency", "k2_bm25_top", "r2_hashed_vectors", "r6_hybrid_ranking", "r9_rrf_fusion", "r13_nearest", "b5_greedy_budget", "e1_citation_audit", "v1_ranking_metrics", "v7_chunk_recall", "a16_sliced_rollup", "i1_incremental_work",
)
LLM = ("op1_quality", "op2_decontaminate", "op3_ann", "op4_chat", "op5_secrets", "op6_packing", "op7_pii", "op8_simhash", "op9_warc", "op10_toxicity", "op11_minhash", "op12_kmv", "op13_collocations")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = dict(own.QUERIES)
    names = list(QUERIES)
    try:
        from colloquy.llm import queries as llm

        known |= llm.QUERIES
        names += LLM
    except ImportError:  # the training-data operators aren't there
        pass
    known["a12_table_counts"](spark, sf_dir).collect()  # the session is warm before the first time counts
    times = {}
    for name in names:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
