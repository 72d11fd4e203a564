"""Scanners on small graphs."""

from cairn.operators import quality


class Items:
    def __init__(self, spark, rows):
        self.rows = spark.createDataFrame(rows, "node_id long, name string, brand string, weight_grams double, price_usd double")

    def item(self):
        return self.rows


def test_duplicates_are_issues(spark):
    rows = [(1, "Arc Haul 60", "Zed", None, None), (2, "arc haul 60", "zed", 5.0, None), (3, "Arc Haul 61", "Zed", 5.0, 1.0), (4, "Arc Haul 60", "Other", 1.0, 1.0), (5, "Mug", "Zed", 1.0, 1.0)]
    got = {(r.entity_id, r.new_value) for r in quality.scan_duplicates(Items(spark, rows)).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3")}
    assert quality.scan_duplicates in quality.SCANNERS


def test_transcription_reads_names_and_prefixes(spark):
    rows = [(1, "Durst tent", "Other", None, None), (2, "Durstonian", "Other", None, None), (4, "Zliter", None, None, None), (5, "The Zliter", "Thermarest", None, None)]
    got = {(r.entity_id, r.description, r.confidence) for r in quality.scan_transcription(Items(spark, rows)).collect()}
    assert got == {("1", "Durst tent", 0.9), ("4", "Zliter", 0.75), ("5", "Thermarest", 0.95)}


def test_copies_are_counted_by_names(spark):
    rows = [(i, ("Arc Haul 60", "arc haul 60", "Arc Haul 61", "Arc Haul 62", "Mug")[i % 5], ("Zed", None)[i % 2], None, 1.0) for i in range(80)]
    want = {}
    for r in quality.scan_duplicates(Items(spark, rows)).collect():
        want[r.confidence] = want.get(r.confidence, 0) + 1
    got = {}
    for r in quality.duplicate_counts(Items(spark, rows)).collect():
        got[r.confidence] = got.get(r.confidence, 0) + r.n
    assert got == want and len(want) > 1


def test_pairs_of_few_names_are_many_tasks(spark):
    from cairn.operators.duplicates import pairs_within_brand

    rows = [(i, f"arc haul {i}", "Zed", None, None) for i in range(60)]
    assert pairs_within_brand(Items(spark, rows)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_classes_lose_no_pair_of_items(spark):
    n = 300
    rows = [(i, ("Arc Haul 60", "arc haul 60", "Arc Haul 61", "Arc Haul 62", " ", "Mug")[i % 6], ("Zed", None, "zed")[i % 3], (None, 5.0)[i % 2], (None, 1.0)[i % 5 == 0]) for i in range(n)]
    of = {i: ((b or "unknown").lower(), name.lower()) for i, name, b, _, _ in rows}
    members = {}
    for i, key in of.items():
        members.setdefault(key, []).append(i)
    want = {(frozenset((int(r.entity_id), int(r.new_value))), r.confidence) for r in quality.scan_duplicates(Items(spark, rows)).collect()}
    got, issues = set(), quality.duplicate_classes(Items(spark, rows)).collect()
    for r in issues:
        one, two = of[int(r.entity_id)], of[int(r.new_value)]
        got |= {(frozenset((a, b)), r.confidence) for a in members[one] for b in members[two] if a != b}
    assert got == want and len(want) > 20 * len(issues)
    assert len(issues) < 2 * n  # linear in copies, where pairs are many times as many
