"""Command line: ``python -m quernel index|search|eval|info|languages|config``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace

from quernel.api import Config, Engine
from quernel.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel", description="Semantic retrieval over source code and documents")
    p.add_argument("--settings", help="JSON file with settings")
    p.add_argument("--env", default=".env", help="file with environment settings")
    p.add_argument("--store", help="folder of the point store")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("index", help="index a git repository")
    a.add_argument("repo")
    a.add_argument("--branch")
    a.add_argument("--full", action="store_true")
    a = sub.add_parser("search", help="search the index")
    a.add_argument("text")
    a.add_argument("--limit", type=int)
    a.add_argument("--threshold", type=float)
    a.add_argument("--offset", type=int, default=0)
    for name in ("language", "kind", "file", "repo"):
        a.add_argument(f"--{name}")
    a.add_argument("--format", choices=("text", "markdown", "graph"), default="text")
    a = sub.add_parser("eval", help="measure retrieval quality")
    a.add_argument("--language")
    a = sub.add_parser("info", help="show a repository")
    a.add_argument("repo")
    sub.add_parser("languages", help="show the supported languages")
    sub.add_parser("config", help="show the settings")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = Config.load(args.settings, args.env)
    if args.store:
        config = replace(config, store=args.store)
    if args.verb == "config":
        print(config.show())
        return
    engine = Engine(build_session(), config)
    if args.verb == "index":
        print(json.dumps(asdict(engine.index(args.repo, branch=args.branch, full=args.full)), indent=1))
    elif args.verb == "search":
        kw = {"limit": args.limit, "threshold": args.threshold, "offset": args.offset} | {k: getattr(args, k) for k in ("language", "kind", "file", "repo")}
        if args.format == "graph":
            nodes, links = engine.search_graph(args.text, **kw)
            print(json.dumps({"nodes": [r.asDict() for r in nodes.collect()], "links": [r.asDict() for r in links.collect()]}))
        else:
            print((engine.search_markdown if args.format == "markdown" else engine.search_text)(args.text, **kw))
    elif args.verb == "eval":
        engine.evaluate(language=args.language).show(truncate=False)
    elif args.verb == "info":
        print(json.dumps(engine.repo_info(args.repo), indent=1))
    else:
        for r in engine.languages().collect():
            print(r.text)


if __name__ == "__main__":
    main()
