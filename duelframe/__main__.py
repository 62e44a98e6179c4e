"""Command line: python -m duelframe COMMAND ...

Tables are Parquet folders or files called images and comparisons under --tables; results are written as Parquet
under --out, or shown. Every command reads, computes and writes DataFrames; nothing is moved or deleted.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import calibration, cleaning, etl, gallery, graph, matrix, pairing, rating, stats, training
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="duelframe", description=__doc__)
    p.add_argument("--tables", default=".")
    p.add_argument("--out")
    p.add_argument("--master")
    groups = p.add_subparsers(dest="group", required=True)

    def group(name: str, *commands: str):
        sub = groups.add_parser(name).add_subparsers(dest="command", required=True)
        return {c: sub.add_parser(c) for c in commands}

    database = group("database", "cleanup", "rebuild", "recalculate")
    database["recalculate"].add_argument("--order", default="default", choices=("default", "reverse", "random"))
    database["recalculate"].add_argument("--seed", type=int)
    group("build", "scores", "split-vectors", "full-vectors")
    train = group("training", "train-model", "hpo")
    train["train-model"].add_argument("--objective", default="regression", choices=("regression", "binary", "multiclass"))
    train["hpo"].add_argument("--cycles", type=int, default=1)
    analyze = group("analyze", "stats", "matrix", "parameters", "graph")
    analyze["matrix"].add_argument("--least", type=int, default=100)
    files = group("files", "cleanup", "tiers")
    files["cleanup"].add_argument("--root", required=True)
    show = group("show", "gallery", "history", "next-pair")
    show["gallery"].add_argument("--tags", nargs="*", default=[])
    show["gallery"].add_argument("--mode", default="and", choices=("and", "or", "both"))
    show["gallery"].add_argument("--sort", default="score_desc", choices=tuple(gallery.SORTS))
    show["gallery"].add_argument("--page", type=int, default=1)
    show["history"].add_argument("filename")
    return p


def run(args: argparse.Namespace) -> DataFrame:
    spark = session(master=args.master)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{args.tables}/{name}")

    key = f"{args.group} {args.command}"
    if key == "database cleanup":
        return cleaning.clean(table("comparisons"), table("images"))
    if key == "database rebuild":
        return etl.rebuild(table("histories"))
    if key == "database recalculate":
        return rating.recompute(table("images"), table("comparisons"), args.order, args.seed)
    if key == "build scores":
        return rating.scores(rating.replay(table("comparisons")))
    if key == "build split-vectors":
        from .operators.vectors import valid_split

        return valid_split(table("split"))
    if key == "build full-vectors":
        from .operators.vectors import join_slots

        split = table("split")
        return join_slots(split, sorted(r[0] for r in split.select("vector_name").distinct().collect()))
    if key.startswith("training"):
        from .operators.vectors import with_scores

        rows = training.split(with_scores(table("vectors"), table("scores")))
        if args.command == "hpo":

            def value(s: training.Setting) -> float:
                model = training.fit(rows.where("not is_test"), "regression", s)
                return stats.regression_metrics(training.predict(model, rows.where("is_test")), "score", "prediction").first()["r2"]

            best = training.Search(value).run(args.cycles)
            return spark.createDataFrame([(*best.key(), best.score, best.seconds)], "max_iter int, max_depth int, step_size double, max_bins int, score double, seconds double")
        out = training.predict(training.fit(rows.where("not is_test"), args.objective), rows.where("is_test"), args.objective)
        return out.withColumn("calibrated", calibration.apply(F.col("prediction"), calibration.build(out, "prediction", "score")))
    if key == "analyze stats":
        return stats.summary(table("images"))
    if key == "analyze matrix":
        records = table("records")
        return matrix.cell_stats(matrix.cells(matrix.parameters(records, [c for c in records.columns if c not in ("id", "score")])), args.least)
    if key == "analyze parameters":
        return stats.category_stats(table("records"), "sampler")
    if key == "analyze graph":
        e = graph.edges(table("comparisons"))
        nodes = graph.universe(e)
        labels = graph.components(nodes, e)
        return graph.stats(nodes, e, labels, graph.chains(labels, e))
    if key == "files cleanup":
        from .sources.files import list_files

        return etl.orphan_plan(list_files(spark, args.root), args.root)
    if key == "files tiers":
        return etl.tier_plan(table("images"))
    if key == "show gallery":
        return gallery.gallery(table("images"), args.tags, args.mode, sort=args.sort, number=args.page)
    if key == "show history":
        from .operators import history

        return history.of_image(table("comparisons"), table("images"), args.filename)
    return pairing.next_pair(table("images"), table("comparisons"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    df = run(args)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    main()
