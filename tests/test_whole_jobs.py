"""Queries run over the whole of their tables."""

import random

from oracle import SF_DIR
from pyspark.sql import functions as F

from quire.plans import analytics, matching, sources, streams
from quire.session import table


def test_similar_labels_of_the_whole_table(spark):
    rng = random.Random(6)
    vocabulary = "red blue old new rod bolt ring steel brass long".split()
    labels = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(1, 601, 7)] + [(700, "Red  rod"), (701, "rod red"), (702, ""), (703, None), (704, "unlike")]
    sets = {i: frozenset((t or "").lower().split()) for i, t in labels}
    least = {w: min(i for i in sets if sets[i] == w) for w in sets.values() if w}
    df = spark.createDataFrame(labels, "id long, label string")
    classes = matching.label_classes(df, "id", "label").cache()
    assert {r.id: (r.class_id, r.members) for r in classes.collect()} == {i: (least.get(w), sum(w == v for v in sets.values()) if w else None) for i, w in sets.items()}
    want = {(least[a], least[b]): round(len(a & b) / len(a | b), 6) for a in least for b in least if a != b and 2 * len(a & b) >= len(a | b) and min(len(a), len(b)) >= 0.7 * max(len(a), len(b))}
    got = matching.label_links(classes).collect()
    assert len(got) == len(want) > 20 and {(r.class_id, r.other): r.score for r in got} == want


def test_similar_labels_are_of_all_parts(spark):
    got = matching.j10_similar_labels(spark, SF_DIR)
    assert got.count() == table(spark, SF_DIR, "part").count() and got.filter("links > 0").count() > 0


def test_activity_counts_every_click(spark):
    events = table(spark, SF_DIR, "events")
    newest = events.agg(F.max(F.to_date("ts"))).first()[0]
    want = events.filter(F.date_diff(F.lit(newest), F.to_date("ts")) < 14).count()
    assert sum(r.n for r in analytics.a7_activity(spark, SF_DIR).collect()) == want


def test_progress_counts_every_event(spark):
    assert streams.r4_progress(spark, SF_DIR).agg(F.sum("steps")).first()[0] == table(spark, SF_DIR, "events").count()


def test_every_text_is_paged_and_every_picture_encoded(spark):
    items = {r.item_id for r in table(spark, SF_DIR, "benchmark").collect()}
    assert {r.item_id for r in sources.s4_text_pages(spark, SF_DIR).collect()} == items
    got = sources.s5_page_images(spark, SF_DIR).collect()
    assert {r.item_id for r in got} == items and {r.item_id for r in got if r.failed} == {i for i in items if i % 10 == 3}
    assert any(r.width == 2048 for r in got)
