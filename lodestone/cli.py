"""Command line: learn embeddings, ask a question, evaluate pipelines, or choose from a menu."""

from __future__ import annotations

import argparse
import json

from lodestone.plans.engine import RetrievalEngine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("embed", help="learn an embedding model from chunks; write it and the chunks' vectors")
    for name in ("chunks", "vectors", "model"):
        s.add_argument(f"--{name}", required=True, help=f"Parquet table of the {name}")
    for name in ("ask", "eval", "menu"):
        s = sub.add_parser(name)
        s.add_argument("--model", help="Parquet table of the model that the vectors were made with")
        s.add_argument("--chunks", required=True, help="Parquet table of chunks")
        s.add_argument("--vectors", required=True, help="Parquet table of vectors")
        s.add_argument("--entities", required=True, help="Parquet table of the entity index")
        s.add_argument("--k", type=int, default=4)
        s.add_argument("--eval-k", type=int, default=10)
        s.add_argument("--dense-k", type=int, default=200)
        s.add_argument("--bm25-k", type=int, default=200)
        s.add_argument("--candidates-k", type=int, default=200)
        s.add_argument("--rrf-k", type=int, default=60)
        s.add_argument("--k-values", default="1,3,5,10")
        s.add_argument("--weight", type=float, default=0.05)
        s.add_argument("--question")
        s.add_argument("--questions")
        s.add_argument("--qrels")
    return p


def engine(spark, args, **models) -> RetrievalEngine:
    from lodestone.operators.latent import LatentEmbedder

    if "embedder" not in models:
        if not args.model:
            raise SystemExit("--model: the table that `embed` wrote with the vectors")
        models["embedder"] = LatentEmbedder.read(spark, args.model)
    read = spark.read.parquet
    return RetrievalEngine(read(args.chunks), read(args.vectors), read(args.entities), **models)


def embed(spark, args) -> None:
    from lodestone.operators import latent

    counted = latent.counted(spark.read.parquet(args.chunks).select("corpus_idx", "text"))
    model = latent.fit(counted)
    model.write(spark, args.model)
    latent.vectors(counted, model).write.mode("overwrite").parquet(args.vectors)


def ask(e: RetrievalEngine, args) -> None:
    found = e.ask(args.question or input("Question: "), args.k, args.dense_k, args.bm25_k, args.candidates_k, args.weight)
    print(found["answer"] or found["context"])
    print(json.dumps(found["sources"], ensure_ascii=False, indent=2))


def evaluate(e: RetrievalEngine, args) -> None:
    from lodestone.operators.metrics import load_qrels, load_questions
    from lodestone.schemas import QRELS, QUESTION
    from lodestone.sources.io import read_jsonl

    out = e.evaluate(load_questions(read_jsonl(e.spark, args.questions, QUESTION)), load_qrels(read_jsonl(e.spark, args.qrels, QRELS)), args.eval_k, args.k_values, args.dense_k, args.bm25_k, args.candidates_k, args.rrf_k, args.weight)
    out["wide"].show(truncate=False)
    out["delta"].orderBy("metric").show(100, truncate=False)


def main(argv: list[str] | None = None, **models) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 1
    from pyspark.sql import SparkSession

    from lodestone.session import ready

    spark = ready(SparkSession.builder.appName("lodestone").getOrCreate())
    if args.command == "embed":
        embed(spark, args)
        return 0
    e = engine(spark, args, **models)
    if args.command != "menu":
        (ask if args.command == "ask" else evaluate)(e, args)
        return 0
    while (choice := input("1 ask, 2 evaluate, 0 leave: ").strip()) != "0":
        if choice in ("1", "2"):
            (ask if choice == "1" else evaluate)(e, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
