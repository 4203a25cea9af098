"""python -m stratiset COMMAND ...: runs over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import checks
from .plans import ladder, programs
from .session import session
from .sources import sidecars, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratiset", description=__doc__)
    parser.add_argument("--master", help="Spark master; that of the environment if left out")
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("ask", help="questions about two words over packed posting lists")
    ask.add_argument("lists")
    ask.add_argument("vocabulary")
    ask.add_argument("word_a")
    ask.add_argument("word_b")
    ask.add_argument("--version", type=int, default=1730)
    ask.add_argument("--document", type=int, default=13, help="master document")
    ask.add_argument("--rel", type=int, default=1730)
    ask.add_argument("--max-terms", type=int, default=0, help="0: all")
    ask.add_argument("--words-first", action="store_true", help="a word of digits is looked up as a word before it counts as an id")
    build = commands.add_parser("build", help="counters and checks of a build")
    build.add_argument("lists")
    build.add_argument("--max-terms", type=int, default=0)
    build.add_argument("--metrics", help="folder of CSV that the counters are appended to")
    build.add_argument("--report", help="folder of CSV for the checks")
    convert = commands.add_parser("convert", help="text of posting lists to a binary file")
    convert.add_argument("text")
    convert.add_argument("out")
    convert.add_argument("--kind", choices=("packed", "global", "auto"), default="packed")
    convert.add_argument("--page-map")
    index = commands.add_parser("index", help="raw text to an inverted index")
    for name in ("text", "borders", "log", "out"):
        index.add_argument(name)
    detect = commands.add_parser("detect", help="versions of articles by the likeness of neighbours")
    for name in ("text", "borders", "out"):
        detect.add_argument(name)
    detect.add_argument("--threshold", type=float, default=0.35)
    ladder = commands.add_parser("ladder", help="timed jobs over the datasets of a catalogue")
    ladder.add_argument("catalogue")
    ladder.add_argument("out", help="folder of CSV that the results are appended to")
    ladder.add_argument("--minutes", type=float, default=30.0)
    ladder.add_argument("--matrix", action="store_true", help="go on after a job that fails or takes too long")
    return parser


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "ask":
        posting, vocab = programs.postings_of(spark, a.lists, a.max_terms), sidecars.vocabulary(spark, a.vocabulary)
        for name, df in programs.answers(posting, vocab, a.word_a, a.word_b, a.version, a.document, a.rel, not a.words_first).items():
            print(name)
            df.show(24, 120)
    elif a.command == "build":
        posting = programs.postings_of(spark, a.lists, a.max_terms)
        found, report = programs.summary(posting), checks.report(posting)
        found.show(1, False, True)
        report.show()
        if a.metrics:
            sinks.append_metrics(found, a.metrics)
        if a.report:
            sinks.append_metrics(report, a.report)
    elif a.command == "convert":
        print(programs.convert_lists(spark, a.text, a.out, a.kind, a.page_map))
    elif a.command == "index":
        print(programs.build_index(spark, a.text, a.borders, a.log, a.out))
    elif a.command == "ladder":
        datasets = [r.asDict() for r in sidecars.catalogue(spark, a.catalogue).collect()]
        found = ladder.climb(spark, datasets, minutes=a.minutes, stop=not a.matrix)
        sinks.append_metrics(found, a.out)
        found.show(100, 60)
    else:
        docs = sidecars.cut_documents(sidecars.borders(spark, a.borders), a.text)
        programs.detect_versions(docs, a.out, a.threshold).show(24)


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    run(session(a.master), a)


if __name__ == "__main__":
    main()
