"""Command line: manifest, build, ask, audit over stored tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessera.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    for name, args in {"manifest": ["root", "out"], "build": ["root", "out"], "ask": ["units", "question"], "audit": ["documents", "labels"]}.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name == "ask":
            sub.add_argument("--as-of", default="2026-01-01")
    return top


def main(argv: list[str] | None = None) -> int:
    from tessera import api
    from tessera.operators import gates
    from tessera.sources import files, sinks

    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "manifest":
        sinks.write_json_lines(files.manifest(spark, args.root), args.out)
    elif args.command == "build":
        rows = files.manifest(spark, args.root)
        texts = files.texts(spark, args.root).select(F.col("path").alias("document_id"), "text")
        for name, df in api.build(spark, rows, texts).items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.command == "ask":
        asked = spark.createDataFrame([(args.question,)], "question string")
        row = api.answer(asked, spark.read.parquet(args.units), args.as_of).first()
        print(row["state"], row["answer"], sep="\n")
    else:
        docs, labels = spark.read.parquet(args.documents), spark.read.parquet(args.labels)
        orphans = labels.join(docs.select("doc_id"), "doc_id", "left_anti")
        issues = gates.together([gates.issue(docs, F.length(F.trim("text")) < 20, "ERROR", "SHORT_TEXT", F.col("doc_id")), gates.issue(orphans, F.lit(True), "ERROR", "LABEL_WITHOUT_DOCUMENT", F.col("doc_id"))])
        print(sinks.report(issues))
        return int(not gates.gate(issues, ["ERROR"]).first()["passed"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
