"""Command line: index, search, info, download."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from passagelake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE
from passagelake.operators.embed import HashingProvider, OnnxProvider
from passagelake.sources.config import DEFAULT_MODEL, INDEX_DIR, Config, models_to_fetch
from passagelake.sources.discover import Discovery


def _list(value: str) -> list[str]:
    return [x for x in value.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="passagelake")
    top.add_argument("--cache-dir", default=os.environ.get("RAG_CACHE_DIR"))
    verbs = top.add_subparsers(dest="verb", required=True)
    many = {"type": _list, "action": "extend", "default": None}
    p = verbs.add_parser("index")
    p.add_argument("path", nargs="?")
    p.add_argument("-o", "--output")
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--chunk-overlap", type=int)
    for flag in ("--ext", "--exclude", "--include"):
        p.add_argument(flag, **many)
    q = verbs.add_parser("search")
    q.add_argument("query")
    q.add_argument("-k", "--top-k", type=int, default=5)
    q.add_argument("--full", action="store_true")
    q.add_argument("--json", action="store_true")
    i = verbs.add_parser("info")
    d = verbs.add_parser("download")
    d.add_argument("--verify", action="store_true")
    for v in (p, q, d):
        v.add_argument("-m", "--model")
    for v in (q, i):
        v.add_argument("-i", "--index", action="append")
    for v in (p, q, i, d):
        v.add_argument("-c", "--config")
        v.add_argument("--only", **many)
    return top


def parse(argv: list[str]) -> argparse.Namespace:
    top = parser()
    a = top.parse_args(argv)
    from_config = a.config or a.only
    if a.verb == "index" and a.path and from_config:
        top.error("a path cannot be used with --config or --only")
    if a.verb in ("search", "info") and a.index and from_config:
        top.error("--index cannot be used with --config or --only")
    if a.verb == "download" and a.model and from_config:
        top.error("--model cannot be used with --config or --only")
    return a


def ignored_flags(a: argparse.Namespace) -> list[str]:
    """Flags of `index` that a configuration overrides."""
    return [f for f in ("output", "model", "chunk_size", "chunk_overlap", "ext", "exclude", "include") if getattr(a, f) is not None]


def provider_of(model: str, cache: str | None = None):
    """hashing-N is built in; other names are looked up in the cache folder, as there is no network access."""
    if model.startswith("hashing-"):
        return HashingProvider(int(model.split("-")[1]))
    return OnnxProvider(str(Path(cache or Path.home() / ".cache/passagelake") / model.replace("/", "--")), model)


def verified(provider) -> int:
    """Embeds a sentence; the number of its dimensions. An empty or a wrong vector is an error."""
    vector = provider.embed(["hello world"])
    if len(vector) != 1 or not len(vector[0]) or len(vector[0]) != provider.dim:
        raise ValueError("the model gave an empty or a wrong vector; its files may be damaged")
    return len(vector[0])


def main(argv: list[str] | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    config = Path(a.config) if a.config else Config.locate()
    if a.verb == "download":
        loaded = Config.load(config) if config and not a.model else None
        missing = 0
        for model in models_to_fetch(a.model, loaded, a.only):
            try:
                provider = provider_of(model, a.cache_dir)
                print(f"{model}: present")
                if a.verify:
                    print(f"{model}: verified, {verified(provider)} dimensions")
            except (OSError, ValueError, ImportError) as error:
                missing += 1
                print(f"{model}: {error}", file=sys.stderr)
        return int(missing > 0)
    from pyspark.sql import SparkSession

    from passagelake.plans import build, federation
    from passagelake.shipping import ship

    spark = SparkSession.builder.appName("passagelake").getOrCreate()
    ship(spark)
    get = lambda m: provider_of(m, a.cache_dir)
    try:
        if a.verb == "index" and a.path:
            found = Discovery(tuple(a.ext or ()), tuple(a.exclude or ()), tuple(a.include or ()))
            print(build.index_folder(spark, a.path, a.output or f"{a.path}/{INDEX_DIR}", get(a.model or DEFAULT_MODEL), a.chunk_size or CHUNK_SIZE, CHUNK_OVERLAP if a.chunk_overlap is None else a.chunk_overlap, found))
        elif a.verb == "index":
            if config is None:
                raise FileNotFoundError("give a path or a configuration")
            if ignored := ignored_flags(a):
                print(f"ignored with a configuration: {', '.join(ignored)}", file=sys.stderr)
            for name, report in build.index_from_config(spark, Config.load(config), get, a.only).items():
                print(name, report)
        else:
            specs = federation.resolve(a.index, a.config, a.only)
            if a.verb == "info":
                for spec in specs:
                    print("\n".join(f"{k}: {v}" for k, v in federation.info(spark, spec).items()))
            else:
                from passagelake.sources import store

                began = time.perf_counter()
                hits = federation.search(spark, specs, a.query, get(a.model or store.load_meta(specs[0].path).model_id), a.top_k, a.model)
                print(federation.as_json(hits) if a.json else f"{federation.as_text(hits, a.full)}\n({time.perf_counter() - began:.2f} s)")
    except (OSError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
