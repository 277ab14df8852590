"""Command line: index a tree, search it, show statistics."""

from __future__ import annotations

import argparse
import os

from sextant import config
from sextant.operators.embed import DIM, HttpEmbedder, LengthEmbedder, query_embedder
from sextant.operators.knn import pad_query
from sextant.operators.search import envelope, hits, resolve_mode, search, to_json, to_text
from sextant.plans.index_run import index, stats
from sextant.session import local_session
from sextant.sources.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sextant")
    p.add_argument("--root", default=".")
    p.add_argument("--endpoint", default="")
    p.add_argument("--offline", action="store_true", help="use the deterministic embedder")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("-w", "--workers", type=int, default=10)
    i.add_argument("--batch-size", type=int, default=8)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-c", "--code", action="store_true")
    s.add_argument("-d", "--docs", action="store_true")
    s.add_argument("--hybrid", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--limit", type=int, default=10)
    sub.add_parser("stats")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    root = os.path.abspath(a.root)
    conf = config.load(os.path.expanduser("~/.sextant/config.json"), f"{root}/.sextant.json", {"endpoint": a.endpoint})
    spark = local_session()
    store = Store(spark, f"{root}/.sextant")
    if a.offline:
        code, docs = LengthEmbedder(1), LengthEmbedder(1000)
    else:
        code, docs = HttpEmbedder(conf.endpoint, conf.code_model, conf.api_key), HttpEmbedder(conf.endpoint, conf.text_model, conf.api_key)
    if a.command == "index":
        r = index(spark, root, store, code, docs, workers=a.workers, batch=a.batch_size)
        for language, n in sorted(r.languages.items()):
            print(f"{n} {language} files to index")
        print("up to date" if r.up_to_date else f"{r.new} new, {r.modified} modified, {r.deleted} deleted, {r.unchanged} unchanged")
    elif a.command == "stats":
        print(stats(store).first().asDict())
    else:
        mode = resolve_mode(a.code, a.docs, a.hybrid)
        table = store.open_table()
        vectors = {}
        for side, e in (("code", code), ("docs", docs)):
            if mode in (side, "hybrid"):
                vectors[side] = pad_query(query_embedder(e)(a.query), DIM)
        found = search(table, vectors, mode, a.limit)
        if a.json:
            print(to_json(envelope(a.query, mode, hits(table, vectors, mode, a.limit), found)).first()[0])
        else:
            for n, row in enumerate(to_text(found).collect(), 1):  # at most the search limit
                print(f"{n}. {row[0]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
