import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstone.llm import near_dedup, skew
from tillstone.llm.components import components
from tillstone.llm.near_dedup import NearDedup


def shingles(text):
    words = cases.WORD.findall(cases.lowered(text))
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """(size, component) per row; components over rows with the least non-null doc_id."""
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if one == old else one for one in label]
    found = []
    for at, (doc, _) in enumerate(rows):
        ids = [rows[other][0] for other in range(len(rows)) if label[other] == label[at] and rows[other][0] is not None]
        found.append((doc, len(sets[at]), min(ids, default=None)))
    return sorted(found, key=str)


def groups(spark, rows, tables, **options):
    found = near_dedup.near_duplicates(cases.frame(spark, rows), tables, NearDedup(**options)).groups
    return sorted((tuple(row) for row in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_odd_documents(spark, tables):
    assert groups(spark, cases.documents(), tables) == expected(cases.documents())


def test_large_group_of_near_copies(spark, tables):
    base = cases.prose(9, 60).split()
    rows = []
    for doc in range(80):
        words = [*base]
        for place in range(doc % 7):
            words[(doc * 13 + place * 29) % 60] = f"w{doc}x{place}"
        rows.append((doc, " ".join(words)))
    assert groups(spark, rows, tables) == expected(rows)


def test_hot_buckets_and_hubs_are_dealt_out(spark, tables, monkeypatch):
    """With small shares and most keys rare the groups are the same."""
    base = cases.prose(11, 50).split()
    rows = [(doc, " ".join([*base[: doc % 50], f"w{doc}", *base[doc % 50 + 1 :]])) for doc in range(120)]
    rows += [(500 + doc, cases.prose(50 + doc // 3, 30)) for doc in range(60)]
    wanted = expected(rows)
    monkeypatch.setattr(near_dedup, "SHARE", 7)
    monkeypatch.setattr(skew.with_totals, "__defaults__", (20,))
    assert groups(spark, rows, tables) == wanted


@pytest.mark.parametrize("most", [2, 5, 1 << 16])
def test_totals_meet_rows_of_frequent_and_rare_keys(spark, tables, most):
    rows = [(at if at % 3 else (1 if at % 2 else None), at) for at in range(100)]
    frame = tables.save(spark.createDataFrame(rows, "k bigint, x bigint"), "frame")
    totals = frame.groupBy("k").agg(F.sum("x").alias("total"), F.count("*").alias("n")).filter("k is null or k != 2")
    wanted = {}
    for key, x in rows:
        wanted[key] = wanted.get(key, 0) + x
    found = skew.with_totals(frame, tables.replace(totals, "totals"), "k", "n", most)
    assert found.columns == ["k", "x", "total"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((k, x, wanted[k]) for k, x in rows if k != 2), key=str)


def test_empty_table(spark, tables):
    assert near_dedup.deduplicated(cases.no_rows(spark), tables).count() == 0


def test_one_document_of_each_group_stays(spark, tables):
    table = cases.frame(spark)
    kept = near_dedup.deduplicated(table, tables)
    assert kept.columns == table.columns
    rows = kept.select("doc_id", "text").collect()
    assert [row["doc_id"] for row in rows if row["text"] and row["text"].startswith(cases.prose(1, 2))] == [1]
    assert sum(not (row["text"] or "").strip() for row in rows) == 5
    assert len(rows) == 5 + 1 + 1 + 5  # the textless, the near copies, the short ones, the others


def test_signature_is_circulant():
    options = NearDedup(circle_bits=9)
    found = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 40, np.uint64))
    turned = options.ranks()
    ranks = turned[:, 0]
    places = (near_dedup.mixed(found + np.uint64(options.seed)) >> np.uint64(55)).astype(int)
    least = near_dedup.signature(found, turned, options)
    assert [min(ranks[(place + k) % 512] for place in places) for k in range(options.coordinates)] == least.tolist()


@pytest.mark.parametrize("similarity", [0.75, 0.8, 0.9])
def test_bands_find_similar_sets(similarity):
    options, source = NearDedup(), np.random.default_rng(5)
    turned, met, near = options.ranks(), 0, 0
    for _ in range(200):
        shared = source.integers(0, 1 << 63, 300, np.uint64)
        own = round(300 * (1 / similarity - 1) / 2)
        pair = [np.unique(np.concatenate([shared, source.integers(0, 1 << 63, own, np.uint64)])) for _ in range(2)]
        least = [near_dedup.signature(one, turned, options) for one in pair]
        met += bool(set(near_dedup.band_keys(least[0], options)) & set(near_dedup.band_keys(least[1], options)))
        bits = [np.unpackbits(np.frombuffer(near_dedup.bits_of(one), np.uint8)) for one in least]
        near += int((bits[0] != bits[1]).sum()) <= near_dedup.far_apart(options)
    assert met == near == 200


def test_components_of_paths_and_stars(spark, tables):
    links = [(at, at + 1) for at in range(100, 160)] + [(7, leaf) for leaf in range(1000, 1100)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint"), tables).collect())
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1000, 1100), 7), 7: 7}


@pytest.mark.parametrize("most", [5, 1 << 12])
def test_rare_buckets_are_shuffled_at_every_size(spark, tables, monkeypatch, most):
    rows = [(doc, cases.prose(20 + doc // 3, 40 + doc % 3)) for doc in range(90)]
    monkeypatch.setattr(near_dedup, "MOST_FREQUENT", most)
    assert groups(spark, rows, tables) == expected(rows)


def test_parities_differ_in_no_more_places_than_sets():
    """No similar pair is ever left out, whatever the sizes, and sets far apart are told apart."""
    source = np.random.default_rng(9)

    def odd(one, other):
        found = [np.unpackbits(np.frombuffer(near_dedup.parities_of(x), np.uint8)) for x in (one, other)]
        return int((found[0] != found[1]).sum())

    for size in (1, 2, 30, 150, 600, 5000):
        for share in (0, 0.02, 0.1, 0.14, 0.3):
            own = round(size * share)
            both = [np.unique(source.integers(0, 1 << 63, size, np.uint64))] * 2
            one, other = (np.unique(np.concatenate([x[own:], source.integers(0, 1 << 63, own, np.uint64)])) for x in both)
            assert odd(one, other) <= len(np.setxor1d(one, other))
    base = source.integers(0, 1 << 63, 150, np.uint64)
    one, other = (np.unique(np.concatenate([base[40:], source.integers(0, 1 << 63, 40, np.uint64)])) for _ in range(2))
    assert 175 * odd(one, other) > 25 * (len(one) + len(other))  # similarity 0.58


def test_few_pairs_are_compared_in_a_group_around_one_text(spark, tables):
    """Copies of one text with four words changed each have a similarity of about 0.6 and meet in many buckets."""
    base, rows = cases.prose(31, 150).split(), []
    for doc in range(150):
        words = [*base]
        for place in range(4):
            words[(doc * 17 + place * 37) % 150] = f"w{doc}x{place}"
        rows.append((doc, " ".join(words)))
    frame, options = cases.frame(spark, rows, extra=False).withColumnRenamed("doc_id", "row"), NearDedup()
    own = near_dedup.sketches(frame, "text", options).withColumnRenamed("row", "node")
    members = near_dedup.bucketed(tables.save(own, "own"), tables, options).withColumn("label", F.col("node"))
    pairs = near_dedup._turn(tables.save(members, "members"), 1 << 20, tables)[0]
    near = pairs.filter(f"differing <= {near_dedup.far_apart(options)}")
    met, left = near.count(), near.filter("175 * odd <= 25 * (a_size + b_size)").count()
    assert met > 2000 and left < met / 10


def test_texts_are_not_sent_by_plans_that_depend_on_size(spark, tables):
    """The list of rows that stay is shuffled even where it is small enough to be sent to all tasks."""
    kept = near_dedup.deduplicated(cases.frame(spark), tables)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
