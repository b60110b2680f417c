from fractions import Fraction

import pytest

from cadence.llm.mixing import REST, in_mixed_order, mix_sources, schedule, shares
from cadence.llm.q_mixing import WEIGHTS

GIVEN = ({"a": .9, **{f"b{i}": .01 for i in range(10)}}, {"a": 1, "b": 2, "c": 4},
         {"x": 1 / 3, "y": 1 / 3, "z": 1 / 3}, {"only": 5}, {"a": 0.0004, "b": 1}, {REST if s is None else s: w for s, w in WEIGHTS.items()},
         {f"s{i}": 1 + i % 3 for i in range(1500)})


def test_schedule_is_within_one_block_of_the_given_weights():
    for weights in GIVEN:
        slots = shares(weights)
        frame, total = sum(slots.values()), sum(Fraction(str(w)) for w in weights.values())
        plan = schedule(slots)
        assert sorted(t for at in plan.values() for t in at) == list(range(frame))
        for s in list(plan)[:40]:
            target, at = Fraction(str(weights[s])) / total, plan[s]
            assert len(at) == target * frame  # whole frames are exact, so the lag does not grow
            done = 0
            for t in range(frame):
                if t % 7 == 0 or (done < len(at) and at[done] == t):
                    assert abs(done - target * t) < 1
                done += done < len(at) and at[done] == t


def test_weights_that_no_frame_holds():
    with pytest.raises(ValueError):
        shares({"a": 0.123456789, "b": 0.7})
    assert shares({"a": 0.5, "b": 0.25, "c": 0.25}, frame=4) == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        shares({"a": 0.5, "b": 0.25, "c": 0.25}, frame=3)


def test_mixed_table(spark):
    rows = [(i, "big" if i % 3 else "a") for i in range(900)] + [(i, f"s{i % 5}") for i in range(900, 1000)]
    docs = spark.createDataFrame([(*r, "t", 5) for r in rows],
                                 "doc_id long, source string, text string, mix_slot int")
    out = mix_sources(docs, {"big": .5, "a": .3, None: .2}, block=4, frame=100)
    assert out.columns == ["doc_id", "source", "text", "mix_slot", "mix_place"]
    got = out.orderBy("mix_slot", "mix_place").collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    assert len({(r.mix_slot, r.mix_place) for r in got}) == 1000
    counts = {"big": 0, "a": 0, REST: 0}
    for r in got:  # while no source has run out, each is within a block of its share
        if r.mix_slot >= 120:  # the rest has 25 blocks at a fifth of the slots
            break
        counts[r.source if r.source in counts else REST] += 1
        for s, w in (("big", .5), ("a", .3), (REST, .2)):
            assert abs(counts[s] - w * 4 * (r.mix_slot + (r.mix_place + 1) / 4)) <= 8
    assert [tuple(r) for r in in_mixed_order(out).collect()] == [tuple(r) for r in got]


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    docs = spark.createDataFrame([(None, None, None), (1, None, ""), (1, "a", "x"), (1, "a", "x"),
                                  (2, "", "y")], schema)
    got = mix_sources(docs, {"a": 1.0}).collect()
    assert len(got) == 5 and len({(r.mix_slot, r.mix_place) for r in got}) == 5
    assert mix_sources(docs.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0.0})


def test_clashing_names_and_long_text(spark):
    docs = spark.createDataFrame([(i, "a", "x" * (3_000_000 if i == 3 else 5), i, "y") for i in range(50)],
                                 "doc_id long, source string, text string, mix_place int, mix_slot string")
    got = mix_sources(docs, {"a": 1, "b": 2}, block=8)
    assert got.columns == ["doc_id", "source", "text", "mix_slot", "mix_place"]
    rows = got.collect()
    assert max(len(r.text) for r in rows) == 3_000_000 and {r.mix_place for r in rows} == set(range(8))
