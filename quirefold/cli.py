"""python -m quirefold: index folders of notes and ask for documents."""

from __future__ import annotations

import argparse
import json
import logging
import os
import signal
import sys
import threading
from pathlib import Path

from quirefold import __version__
from quirefold.lang.parser import QueryError
from quirefold.shell import Shell, nearest
from quirefold.sinks import outputs
from quirefold.sources import filters

TOPICS = ("index", "index build", "index update", "index tidy", "query", "shell", "server", "filters", "language")

LANGUAGE = """A query is a list of statements and clauses, all of which must hold.
  statement   -?category operator value      -t=draft, d>="January 1, 2025", T:"meeting minutes"
  clause      (and ...) or (or ...)          closing brackets may be left out at the end
categories    p path, T title, h headings, m meta (texts); a author, t tags, l links (sets); d date, f filetime (dates)
operators     = != (sets: in, not in), : ~ (contains, or about a date), / (regular expression), < <= > >= (dates)
Statements about a set hold if one element meets them all; a missing value meets none."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirefold", description=__doc__, add_help=True)
    p.add_argument("--root", default=".", help="folder of the notes")
    p.add_argument("--db", default=os.path.expanduser("~/.local/share/quirefold"), help="folder of the store")
    p.add_argument("--logLevel", default="warning", choices=["debug", "info", "warning", "error"])
    p.add_argument("--logJson", action="store_true", help="log lines as JSON")
    p.add_argument("--logFile", help="log to a file")
    p.add_argument("--numWorkers", type=int, default=os.cpu_count(), help="threads of a local session")
    p.add_argument("--dateFormat", default=outputs.RFC3339, help="pattern of dates in custom output")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    q = sub.add_parser("query", aliases=["q"], help="ask for documents")
    q.add_argument("--outFormat", default="default", choices=["default", "json", "yaml", "pathonly", "custom"])
    q.add_argument("--outCustomFormat", default=outputs.DEFAULT_FORMAT)
    q.add_argument("--docSeparator", default="\n")
    q.add_argument("--listSeparator", default=", ")
    q.add_argument("--sortBy", default="")
    q.add_argument("--sortDesc", action="store_true")
    q.add_argument("--optLevel", type=int, default=0)
    q.add_argument("text", nargs="+")
    i = sub.add_parser("index", aliases=["i"], help="build, update or tidy the store")
    for flag in ("ignoreBadDates", "ignoreMetaError", "ignoreMeta", "ignoreHeadings", "ignoreLinks", "ignoreHidden"):
        i.add_argument(f"--{flag}", action="store_true")
    i.add_argument("--filter", action="append", help="Name_parameter; may be given several times, all must accept")
    i.add_argument("subcommand", nargs="?", default="build", choices=["build", "update", "tidy"])
    sub.add_parser("shell", help="look into queries")
    s = sub.add_parser("server", help="answer queries")
    s.add_argument("--address", default="127.0.0.1", help="an address, or unix:PATH")
    s.add_argument("--port", type=int, default=8080)
    sub.add_parser("completions")
    h = sub.add_parser("help")
    h.add_argument("topic", nargs="*")
    return p


def session(args: argparse.Namespace):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("quirefold").config("spark.sql.session.timeZone", "UTC")
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        # The store lies where all executors reach it; so do its intermediate tables.
        b = b.config("spark.checkpoint.dir", f"{uri(args.db)}/_scratch")
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not os.environ.get("SPARK_REMOTE"):
        b = b.master(f"local[{max(1, args.numWorkers or 1)}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def log_to(args: argparse.Namespace) -> None:
    class Lines(logging.Formatter):
        def format(self, r: logging.LogRecord) -> str:
            return json.dumps({"time": self.formatTime(r), "level": r.levelname, "msg": r.getMessage()}) if args.logJson else super().format(r)

    handler = logging.FileHandler(args.logFile) if args.logFile else logging.StreamHandler()
    handler.setFormatter(Lines("%(asctime)s %(levelname)s %(message)s"))
    logging.basicConfig(level=args.logLevel.upper(), handlers=[handler], force=True)


def uri(path: str) -> str:
    return path if "://" in path else Path(path).absolute().as_uri()


def index(args: argparse.Namespace, spark, out) -> int:
    from quirefold.operators.store import DocumentStore, DuplicatePathError
    from quirefold.runtime import materialize
    from quirefold.sources import crawl, markdown

    kept = DocumentStore(spark, uri(args.db))
    if args.subcommand == "tidy":
        kept.tidy()
        return 0
    options = markdown.ParseOptions(not args.ignoreMeta, not args.ignoreHeadings, not args.ignoreLinks, args.ignoreBadDates, args.ignoreMetaError)
    files = crawl.crawl(spark, uri(args.root), args.ignoreHidden)
    parsed = materialize(markdown.parse(filters.accept(files, args.filter or filters.DEFAULTS), options), "parsed")
    docs, errors = markdown.split_errors(parsed)
    for r in errors.toLocalIterator():
        logging.warning("%s: %s", r["path"], r["error"])
    try:
        kept.put(docs) if args.subcommand == "build" else kept.update(docs)
    except DuplicatePathError as e:
        print(f"error: {e}; use index update", file=out)
        return 1
    stats = parsed.selectExpr("count_if(error IS NULL) AS good", "count_if(error IS NOT NULL) AS bad").first()
    print(f"{stats['good']} documents, {stats['bad']} errors", file=out)
    return 0


def query(args: argparse.Namespace, spark, out) -> int:
    from quirefold.api import Corpus
    from quirefold.operators.store import DocumentStore

    found = Corpus(DocumentStore(spark, uri(args.db)).read()).query(" ".join(args.text), args.optLevel).sort(args.sortBy, args.sortDesc)
    options = {}
    if args.outFormat == "custom":
        options = {"pattern": args.outCustomFormat, "date_format": args.dateFormat, "list_separator": args.listSeparator}
    if found.docs.isEmpty():
        print("No results.", file=out)
        return 0
    separator = args.docSeparator if args.outFormat == "custom" else "\n"
    for piece in outputs.stream(found.docs, args.outFormat, separator, **options):
        out.write(piece)
    return 0


def serve(args: argparse.Namespace, spark) -> int:
    from quirefold import server
    from quirefold.api import Corpus
    from quirefold.operators.store import DocumentStore

    kept = DocumentStore(spark, uri(args.db))
    corpus = lambda: Corpus(kept.read())  # noqa: E731 (each query asks the latest version)
    unix = args.address.removeprefix("unix:") if args.address.startswith("unix:") else None
    running = server.serve_unix(corpus, unix) if unix else server.serve_http(corpus, args.address, args.port)
    stop = server.every(3600, lambda: (kept.tidy(), logging.info("store: %s", kept.info())))
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, signal.getsignal(signal.SIGINT))
    try:
        running.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        stop.set()
        if not running.drain():
            logging.error("queries were still running")
        running.server_close()
        if unix:
            Path(unix).unlink(missing_ok=True)
    return 0


def help_on(topic: str, out) -> int:
    if topic in ("", "help"):
        parser().print_help(out)
        print("\ntopics: " + ", ".join(TOPICS), file=out)
    elif topic == "language":
        print(LANGUAGE, file=out)
    elif topic == "filters":
        print("filters: " + ", ".join(filters.FILTERS) + "\ndefault: " + ", ".join(filters.DEFAULTS), file=out)
    elif topic == "shell":
        from quirefold.shell import HELP

        print(HELP, file=out)
    elif topic.split(" ")[0] in ("index", "i", "query", "q", "server"):
        parser()._subparsers._group_actions[0].choices[topic.split(" ")[0]].print_help(out)
        if topic.startswith("q"):
            print("\n" + LANGUAGE, file=out)
    else:
        near = nearest(topic, list(TOPICS))
        print(f"no topic {topic!r}" + (f", did you mean {near!r}?" if near else ""), file=out)
        return 1
    return 0


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    args = parser().parse_args(argv)
    log_to(args)
    if args.command in (None, "help"):
        return help_on(" ".join(getattr(args, "topic", [])), out)
    if args.command == "completions":
        print("There are no completions yet.", file=out)
        return 0
    spark = spark or session(args)
    try:
        if args.command in ("index", "i"):
            return index(args, spark, out)
        if args.command in ("query", "q"):
            return query(args, spark, out)
        if args.command == "server":
            return serve(args, spark)
        from quirefold.api import Corpus
        from quirefold.operators.store import DocumentStore

        Shell(Corpus(DocumentStore(spark, uri(args.db)).read()), out, {k: str(v) for k, v in vars(args).items()}).run()
        return 0
    except (QueryError, filters.FilterError, outputs.FormatError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
