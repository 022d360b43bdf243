"""python -m attestor: demo | query NAME SF_DIR | list"""

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from attestor.functions.workers import prepare
    from attestor.plans import catalogue, mini_corpus

    if args[:1] == ["list"]:
        print("\n".join(catalogue.queries()))
        return 0
    spark = SparkSession.builder.appName("attestor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    prepare(spark)
    if args[:1] == ["query"] and len(args) == 3:
        catalogue.queries()[args[1]](spark, args[2]).show(50, truncate=False)
        return 0
    if args[:1] in (["demo"], ["ask"]):
        texts = args[1:] or mini_corpus.QUESTIONS
        for r in mini_corpus.ask(spark, mini_corpus.corpus_claims(spark), texts)["answers"].orderBy("question_id").collect():
            print(f"{texts[r['question_id']]}\n  {r['status']}: {' '.join(r['sentences'] + r['gaps'])}")
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
