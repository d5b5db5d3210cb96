"""Command line: ``python -m webloom.cli fetch URL [-o md|json] [--user-agent A]``, ``rpc`` (lines on standard input), ``--guide``."""

from __future__ import annotations

import argparse
import sys
import tempfile
import threading

from pyspark.sql import SparkSession

from webloom.api import FetchRequest, FetchTool
from webloom.operators.sinks import front_matter, response_json
from webloom.options import TOOL_GUIDE


def _session() -> SparkSession:
    return SparkSession.builder.appName("webloom").config("spark.ui.enabled", "false").getOrCreate()


def _serve(spark: SparkSession) -> int:
    """Answers the lines of standard input until it ends: they are appended to a file, which a stream answers in batches."""
    from webloom.streaming.server import committed, live_captures, serve

    with tempfile.TemporaryDirectory(prefix="webloom-rpc-") as top:
        spool = f"{top}/lines"
        open(spool, "wb").close()
        ended = threading.Event()

        def take() -> None:
            with open(spool, "ab", buffering=0) as f:
                for line in sys.stdin:
                    f.write((line.rstrip("\r\n") + "\n").encode("utf-8", "surrogatepass"))
            ended.set()

        threading.Thread(target=take, daemon=True).start()
        query = serve(spark, spool, f"{top}/out", f"{top}/state", live_captures()).trigger(processingTime="50 milliseconds").start()
        shown: set[str] = set()

        def show() -> None:
            for path in committed(f"{top}/out"):
                if path not in shown:
                    shown.add(path)
                    with open(path, encoding="utf-8") as f:
                        sys.stdout.write(f.read())
            sys.stdout.flush()

        try:
            while query.isActive and not ended.wait(0.1):
                show()
            if query.isActive:
                query.processAllAvailable()
            show()
        finally:
            query.stop()
        if failed := query.exception():
            raise ValueError(str(failed))
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="webloom")
    parser.add_argument("--guide", action="store_true")
    sub = parser.add_subparsers(dest="command")
    one = sub.add_parser("fetch")
    one.add_argument("url")
    one.add_argument("-o", "--output", choices=["md", "json"], default="md")
    one.add_argument("--user-agent")
    sub.add_parser("rpc")
    known = parser.parse_args(args)
    if known.guide:
        print(TOOL_GUIDE)
        return 0
    try:
        if known.command == "fetch":
            asked = FetchRequest(known.url, as_markdown=True)
            out = FetchTool(user_agent=known.user_agent, spark=_session()).results(asked).select("error_message", front_matter().alias("md"), response_json(pretty=True).alias("json")).first()
            if out["error_message"]:
                raise ValueError(out["error_message"])
            print(out[known.output])
            return 0
        if known.command == "rpc":
            return _serve(_session())
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except BrokenPipeError:
        return 0
    parser.print_help(sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
