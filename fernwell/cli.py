"""Command line: analyse a file, profile it, calibrate or evaluate labels, draw a labelling sample, or make synthetic data."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("fernwell").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fernwell")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "profile", "sample", "evaluate", "calibrate", "check"):
        s = sub.add_parser(name)
        s.add_argument("csv")
        s.add_argument("--profile")
        s.add_argument("--profiles", help="folder of profile files")
        s.add_argument("--out-dir", default="out")
        s.add_argument("--seed", type=int, default=0)
        if name == "run":
            s.add_argument("--labelling", choices=("baseline", "none"), default="baseline")
        if name == "sample":
            s.add_argument("--n", type=int, default=200)
            s.add_argument("--force", action="store_true")
        if name in ("evaluate", "calibrate", "check"):
            s.add_argument("--truth", required=name == "evaluate", help="hand labels; calibration leaves their reviews out")
        if name == "evaluate":
            s.add_argument("--sample", type=int, help="so many hand-labelled reviews, in the same shares of true sentiments")
            s.add_argument("--check-only", action="store_true", help="say how far labelling has come and what is wrong, and stop")
        if name == "check":
            s.add_argument("--key-file", help="file that holds the model's key; the key is never printed")
            s.add_argument("--prices", type=float, nargs=2, default=(3.0, 15.0), help="of a million input and output tokens")
    s = sub.add_parser("synthesize")
    s.add_argument("--rows", type=int, default=3000)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--out-dir", default="out")
    a = p.parse_args(argv)
    from fernwell.operators.cleaning import process
    from fernwell.plans.pipeline import PipelineError, run_analysis
    from fernwell.sources import sinks
    from fernwell.sources.feedback import DataValidationError, read_truth
    from fernwell.sources.profile import ProfileError

    spark = session()
    try:
        if a.command == "synthesize":
            from fernwell.sources.synthetic import dirty_feedback

            dirty_feedback(spark, a.rows, a.seed).write.mode("overwrite").csv(a.out_dir, header=True)
        elif a.command == "run":
            result = run_analysis(spark, a.csv, a.profile, a.labelling, seed=a.seed, folder=a.profiles)
            print("\n".join(sinks.write_tables(result, a.out_dir)))
        elif a.command == "profile":
            result = run_analysis(spark, a.csv, a.profile, "none", folder=a.profiles)
            result.report.summary_table(spark).show(100, truncate=False)
            for t in result.tables.values():
                if t.available:
                    print(f"\n{t.title}")
                    t.frame().show(15, truncate=False)
        elif a.command == "sample":
            data, _, found = process(spark, a.csv, a.profile, folder=a.profiles)
            sinks.labelling_sample(data, a.out_dir, a.n, a.seed, tuple(found.flags), a.force)
            print(sinks.labelling_guide(found))
        elif a.command == "calibrate":
            from fernwell.plans.calibrate import calibrate

            data, _, found = process(spark, a.csv, a.profile, folder=a.profiles)
            chosen, sections = calibrate(data, found, read_truth(spark, a.truth) if a.truth else None)
            print("negative_max {}, positive_min {}, complaint_penalty {}".format(*chosen))
            sinks.evaluation_report(sections, a.out_dir)
        elif a.command == "check":
            from fernwell.plans.evaluate import readiness

            data, _, found = process(spark, a.csv, a.profile, folder=a.profiles)
            key = open(a.key_file, encoding="utf-8").read() if a.key_file else None
            for name, said in readiness(data, found, key, read_truth(spark, a.truth) if a.truth else None, *a.prices).items():
                print(f"{name}: {said}")
        else:
            from fernwell.plans.evaluate import evaluate, progress, sample_truth

            truth = read_truth(spark, a.truth)
            if a.check_only:
                data, _, found = process(spark, a.csv, a.profile, folder=a.profiles)
                for section in progress(truth, data, found).values():
                    section.show(100, truncate=False)
                return 0
            result = run_analysis(spark, a.csv, a.profile, "baseline", folder=a.profiles)
            sinks.evaluation_report(evaluate(result, sample_truth(truth, a.sample, a.seed) if a.sample else truth), a.out_dir)
    except (DataValidationError, ProfileError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 1
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
