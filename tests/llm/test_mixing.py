import pytest
from pyspark.sql import functions as F

from trailgraph.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in capped}
        capped |= over
    return target


def check(df):
    sized = mixing.sized_documents(df)
    out = mixing.mix(sized, ["doc_id", "source"]).collect()
    assert len(out) == df.count()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s, n in sizes.items():
        own = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == n and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * mixing.PACKET + 1
    assert sum(r["taken"] for r in out) == int(1.5 * sum(sizes.values()))
    return sorted((tuple(r) for r in out), key=repr)


def test_documents(docs):
    assert check(docs) == check(docs.repartition(7))


def test_odd(odd, none):
    check(odd)
    assert mixing.mix(mixing.sized_documents(none), ["doc_id"]).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixing.mix_documents(none).count() == 0


def test_copies_are_whole_and_near_the_targets(docs):
    counts = mixing.mix_documents(docs).groupBy("doc_id", "source").count()
    assert counts.agg(F.max("count")).first()[0] == 2
    taken = counts.join(mixing.mix(mixing.sized_documents(docs), ["doc_id"]), "doc_id").groupBy("source", "target")
    for r in taken.agg(F.sum(F.col("count") * F.col("size")).alias("n"), F.max("size").alias("most")).collect():
        assert abs(r["n"] - r["target"]) <= r["most"]


def test_queues_are_served_by_finish_time(docs, odd, monkeypatch):
    """What is taken is what serving all packets in order of virtual finish time takes until the budget is spent."""
    monkeypatch.setattr(mixing, "PACKET", 50)
    for df in (docs, odd):
        out = mixing.mix(mixing.sized_documents(df), ["doc_id", "source"]).collect()
        sizes = {}
        for r in out:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        packets = []
        for i, r in enumerate(out):
            place = names.index(r["source"])
            for epoch in range(2):
                for first in range(0, max(1, r["size"]), 50):
                    words = min(50, r["size"] - first)
                    packets.append(((r["start"] + first + words + epoch * r["source_size"]) * (10 // (5, 2, 1)[place % 3]), place, epoch, r["start"], i, words))
        left, taken = int(1.5 * sum(sizes.values())), [0] * len(out)
        for *_, i, words in sorted(packets):
            taken[i] += min(words, left)
            left -= min(words, left)
        assert taken == [r["taken"] for r in out]
        for s in names:  # the queue of a source is gapless
            end = 0
            for r in sorted((r for r in out if r["source"] == s), key=lambda r: (r["start"], r["start"] + r["size"])):
                assert r["start"] == end
                end += r["size"]


def test_carried_columns_that_clash(docs):
    from pyspark.sql import functions as F

    sized = mixing.sized_documents(docs).withColumn("start", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(None).cast("long"))
    out = mixing.mix(sized, ["doc_id", "start", "a.b", "id"])
    assert out.columns == ["doc_id", "a.b", "id", *mixing.PLANNED] and out.where("id IS NULL").count() == docs.count()
