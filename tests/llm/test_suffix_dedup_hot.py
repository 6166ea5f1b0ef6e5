import hashlib
import random

import numpy as np

from treeledger.llm import suffix_dedup


def test_a_frequent_line_between_different_neighbours_stays_out_of_the_buckets(spark, monkeypatch):
    bound = 20_000
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bound)
    sort_bucket = suffix_dedup.sort_bucket

    def bounded(group):
        sizes = group["text"].map(len).groupby(group["gram"]).sum()
        assert sizes.max() <= bound, "a representative's stretches were gathered in one group"
        return sort_bucket(group)

    monkeypatch.setattr(suffix_dedup, "sort_bucket", bounded)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=60))
    line = "This line of some fifty characters is in many texts."
    few = [word() for _ in range(4)]
    rows = [(k, f"{word()}\n{line}\n{word()}") for k in range(700)]
    rows += [(k, f"{rng.choice(few)}\n{line}\n{rng.choice([word(), *few])}") for k in range(700, 900)]
    rows += [(900, f"{rows[3][1]} {rows[3][1]}"), (901, f"{line}{line}{line}"), (902, f"{line}{line}{line}!")]
    seen, expected = set(), {}
    for doc_id, text in rows:
        data = text.encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                covered[k : k + 100] = True
            seen.add(data[k : k + 100])
        expected[doc_id] = (int(covered.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest())
    out = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in out} == expected
    assert sum(n for n, _ in expected.values()) > 10_000
