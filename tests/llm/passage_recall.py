"""How often ``repeated_passages`` finds a passage of some words inside long lines: run by hand, prints a table.

Texts of invented words, each passage put into two texts at random places; as it is, or as a near copy with every 20th
or 30th word changed.
"""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from pyspark.sql import SparkSession

from burstline.llm import substring_dedup

PASSAGES = 400


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20_000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    print("words, changed every: found of", PASSAGES, "passages; documents without one that are found")
    for length, step in ((51, 0), (60, 0), (75, 0), (100, 0), (60, 30), (60, 20), (100, 30), (100, 20)):
        docs = []
        for p in range(PASSAGES):
            passage = words(length)
            near = [w if not step or i % step else "changed" + w for i, w in enumerate(passage, 1)]
            docs += [(3 * p, " ".join(words(rng.randint(40, 120)) + passage + words(rng.randint(40, 120)))), (3 * p + 1, " ".join(words(rng.randint(40, 120)) + near + words(rng.randint(40, 120)))), (3 * p + 2, " ".join(words(200)))]
        found = {r[0] for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").distinct().collect()}
        print(length, step, ":", sum(3 * p + 1 in found for p in range(PASSAGES)), ";", sum(3 * p + 2 in found for p in range(PASSAGES)), flush=True)


if __name__ == "__main__":
    main()
