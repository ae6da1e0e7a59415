"""Command line: build-lexicon, build-morph, build-freq, build-bigram, analyze, check. Exit status 0 clean, 1 problems, 2 error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vidra.operators import morphology
from vidra.plans.checker import Checker
from vidra.sources import readers, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vidra", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("build-lexicon", "build-morph", "build-freq", "build-bigram"):
        s = sub.add_parser(verb)
        s.add_argument("out")
        s.add_argument("inputs", nargs="+")
    s = sub.add_parser("analyze")
    s.add_argument("morph")
    s.add_argument("words", nargs="+")
    s = sub.add_parser("check")
    s.add_argument("lexicon")
    s.add_argument("text", nargs="?")
    s.add_argument("--file")
    s.add_argument("--stdin", action="store_true")
    for table in ("morph", "freq", "bigram"):
        s.add_argument(f"--{table}")
    s.add_argument("--json", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.verb == "build-lexicon":
        tables.build_lexicon(readers.word_list(spark, *a.inputs), a.out)
    elif a.verb == "build-morph":
        tables.build_morphology(readers.morphology_rows(spark, *a.inputs), a.out)
    elif a.verb == "build-freq":
        tables.build_frequency(readers.counts(spark, *a.inputs), a.out)
    elif a.verb == "build-bigram":
        tables.build_bigrams(readers.counts(spark, *a.inputs, pairs=True), a.out)
    elif a.verb == "analyze":
        words = spark.createDataFrame([(w,) for w in a.words], "word string")
        for r in morphology.dump(words, tables.read(spark, "morph", a.morph)).collect():
            print(f"{r['word']}\t{r['lemma'] or '?'}\t{r['tags'] or ''}", file=out)
    else:
        text = sys.stdin.read() if a.stdin else a.text
        docs = readers.text_document(spark, text, a.file)
        more = {t: tables.read(spark, t, getattr(a, t)) for t in ("morph", "freq", "bigram") if getattr(a, t)}
        found = Checker(tables.read(spark, "lexicon", a.lexicon), **more).check(docs).cache()
        if a.json:
            # One array for all documents, in their order; it is printed as it comes.
            print("[" + ",".join(body for r in tables.as_json(found).orderBy("doc_id").toLocalIterator() if (body := r["json"][1:-1])) + "]", file=out)
        else:
            n = docs.agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).collect()[0][0]
            for line in tables.report(found, n):
                print(line, file=out)
        return int(found.count() > 0)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("vidra").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except Exception as e:  # noqa: BLE001  the exit status says so
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
