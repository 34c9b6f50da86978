"""The overview job: named statistics of one works table, run independently."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from quillgraph.operators import graph, stats

Plan = Callable[[DataFrame], DataFrame]

OVERVIEW: Mapping[str, Plan] = {
    "dataset_size": stats.dataset_size,
    "unique_authors": stats.unique_authors,
    "unique_works": stats.unique_works,
    "unique_teams": stats.unique_teams,
    "works_by_country": lambda w: stats.in_order(stats.works_by_country(w), "country"),
    "works_by_concept": lambda w: stats.in_order(stats.works_by_concept(w), "concept"),
    "citations_distribution": lambda w: stats.citation_distribution(w).select("citation_count"),
    "works_by_topic": lambda w: stats.in_order(stats.works_by_topic(w), "topic"),
    "graph/edges": lambda w: graph.bipartite_edges(graph.authorships(w)),
}


def run(works: DataFrame, folder: str, plans: Mapping[str, Plan] = OVERVIEW) -> DataFrame:
    """Write each statistic below ``folder``; one failing does not stop the rest.

    Returns ``(stat, status, error)``.
    """
    report = []
    for name, plan in plans.items():
        try:
            plan(works).write.mode("overwrite").parquet(f"{folder}/{name}")
            report.append((name, "ok", None))
        except Exception as failure:  # reported, and the next statistic is tried
            report.append((name, "failed", str(failure).splitlines()[0]))
    return works.sparkSession.createDataFrame(report, "stat string, status string, error string")
