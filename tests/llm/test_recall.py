"""Near-duplicate links of a stated query set against all rows, by brute force; RECALL_DIR names another folder of tables."""

import os

from paperloom.llm import bagminhash, near_dups

DATA = os.environ.get("RECALL_DIR", "/root/testdata/sf0.01")


def test_recall_of_links(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    bags = {r["doc_id"]: bagminhash.shingles(" ".join((r["text"] or "").lower().split())) for r in docs.select("doc_id", "text").collect()}
    links = found = wrong = 0
    for d in (d for d in bags if d % 50 == 0):
        for e, bag in bags.items():
            low, high = sorted((len(bags[d]), len(bag)))
            if d != e and low >= 0.8 * high and bagminhash.overlap(bags[d], bag) >= 0.8:
                links += 1
                found += classes[d] == classes[e]
    print(f"{found} of {links} links of documents divisible by 50 are within classes")
    assert links > 0 and found >= 0.9 * links
