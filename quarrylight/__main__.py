"""``python -m quarrylight analyze DIR [--json]``, ``health DIR``, ``dead-code DIR [--json]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import engine


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylight", description="Analyse a source tree.")
    parser.add_argument("command", choices=["analyze", "health", "dead-code"])
    parser.add_argument("directory")
    parser.add_argument("--json", action="store_true", help="a JSON document instead of text")
    parser.add_argument("--max-files", type=int, default=engine.tree.MAX_FILES)
    asked = parser.parse_args(args)
    session = spark or SparkSession.builder.appName("quarrylight").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    a = engine.analyze(session, asked.directory, asked.max_files)
    if asked.command == "health":
        print(engine.health_line(a))
    elif asked.command == "analyze":
        print(engine.to_json(a) if asked.json else engine.report(a))
    elif asked.json:
        rows = a.dead_code.orderBy("file_path", "fn_ord").select("name", "file_path", "start_line", "language", "safe").collect()
        print(json.dumps([r.asDict() for r in rows]))
    else:
        print("\n".join(engine.dead_listing(a)))
    a.close()
    if spark is None:
        session.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
