"""Command line: judge a folder of results, list labels, read XML, or run any registered query."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from strataline.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataline")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="judge results_<llm>/<parse_type>/*.json against xml/*.xml")
    e.add_argument("root")
    e.add_argument("out")
    e.add_argument("--llms", default="", help="comma-separated; all if empty")
    e.add_argument("--skip-evaluate", action="store_true", help="report from an evaluation kept before")
    x = sub.add_parser("xml", help="print an XML file as its record, or the schema of the record")
    x.add_argument("file")
    x.add_argument("--schema", action="store_true")
    t = sub.add_parser("parse", help="keep texts of a parse type, and what is derived from them")
    t.add_argument("root")
    t.add_argument("parse_type")
    n = sub.add_parser("labels", help="write the labels of all results")
    n.add_argument("root")
    n.add_argument("out")
    q = sub.add_parser("query", help="run a registered query over a folder of parquet tables")
    q.add_argument("name")
    q.add_argument("data")
    q.add_argument("out")
    a = p.parse_args(argv)
    if a.command == "xml":
        from strataline.operators.schema import json_schema
        from strataline.sources.files import xml_record

        record = xml_record(Path(a.file).read_bytes())
        print(json.dumps(json_schema(record) if a.schema else record, ensure_ascii=False, indent=2))
        return 0
    spark = build_session("strataline")
    if a.command == "evaluate":
        from strataline.plans import pipeline

        from strataline.sources import files

        llms = [v for v in a.llms.split(",") if v] or None
        if not a.skip_evaluate and not files.results_exist(spark, a.root):
            print("no results", file=sys.stderr)
            return 1
        tables = pipeline.run(spark, a.root, a.out, llms, skip_evaluate=a.skip_evaluate, known=pipeline.KNOWN_LLMS)
        if tables["overall"].limit(1).count() == 0:
            print("no evaluations", file=sys.stderr)
            return 1
        return 0
    if a.command == "labels":
        from strataline.plans import pipeline
        from strataline.sources import files

        files.write_labels(pipeline.label_universe(files.scan_results(spark, a.root)), a.out)
        return 0
    if a.command == "parse":
        from strataline.sources import parsed

        print(parsed.derive(spark, a.root, a.parse_type))
        return 0
    from strataline.plans import registry

    registry.everything()[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
