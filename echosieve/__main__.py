"""python -m echosieve SOURCE OUT: rewrite the markdown files under SOURCE."""

from __future__ import annotations

import argparse

from echosieve.config import CLI, PROFILES, SCAFFOLDS, WEB, Settings

#: Settings whose defaults follow the dialect.
CHOICES = ("scaffold", "paragraph_radius", "min_match_score", "min_tokens", "min_shared", "max_candidates_per_token", "frontier_growth", "pattern_min_score")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="echosieve", description=__doc__)
    p.add_argument("source", help="a markdown file, or a folder of them")
    p.add_argument("out", help="the folder that results go to")
    p.add_argument("--dialect", choices=("web", "cli"), default="web")
    p.add_argument("--profile", choices=sorted(PROFILES), default="med")
    p.add_argument("--scaffold", choices=sorted(SCAFFOLDS), help="default: light for web, off for cli")
    p.add_argument("--profiles", help="comma list: write every profile's local rewriting too")
    p.add_argument("--paragraph-radius", type=int, help="default: 12 for web, 6 for cli")
    p.add_argument("--min-match-score", type=float, help="default: 0.2 for web, 0.24 for cli")
    p.add_argument("--min-tokens", type=int)
    p.add_argument("--min-shared-content", type=int, dest="min_shared")
    p.add_argument("--max-candidates-per-token", type=int)
    p.add_argument("--frontier-growth", type=int, help="0: the profile's")
    p.add_argument("--pattern-min-score", type=float)
    p.add_argument("--shared", action="store_true", help="mine models from all files together")
    p.add_argument("--split", type=int, default=0, help="mine models from so many balanced groups")
    p.add_argument("--crossover", action="store_true", help="groups share their border files")
    p.add_argument("--report", action="store_true")
    p.add_argument("--bakeoff", action="store_true")
    p.add_argument("--top", type=int, default=40, help="rows to print")
    a = p.parse_args(argv)
    for k in CHOICES:  # what isn't given follows the dialect
        if getattr(a, k) is None:
            setattr(a, k, getattr(CLI if a.dialect == "cli" else WEB, k))
    return a


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    from pyspark.sql import SparkSession

    from echosieve.operators.hotspots import top_hotspots
    from echosieve.plans.driver import run_files
    from echosieve.sources.sinks import metrics_report

    given = {k: getattr(a, k) for k in ("dialect", "profile", *CHOICES)}
    spark = SparkSession.builder.appName("echosieve").getOrCreate()
    done, seconds = run_files(spark, a.source, a.out, Settings(**given), a.profiles, a.shared, a.split, a.crossover, a.report, a.bakeoff)
    for r in metrics_report(done.metrics).limit(a.top + 1).collect():
        print(r["line"])
    for r in top_hotspots(done.hotspots, 5, a.dialect).orderBy("doc_id", "place").limit(a.top).collect():
        print(f"{r['doc_id']} {r['place']}. {r['badness']:.3f} `{r['section']}` L{r['start_line']} ({r['match_count']} matches, {r['hint']}): {r['text'][:80]}")
    print(", ".join(f"{k} {v:.1f} s" for k, v in seconds.items()))


if __name__ == "__main__":
    main()
