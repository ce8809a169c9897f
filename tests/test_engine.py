import itertools
import random

import pytest
from pyspark.sql import functions as F

from rawscan import JsonQuery, TermList, contains, custom, decompose, endswith, equals, execute, search, startswith, stats, stats_report
from rawscan.cli import answer, compare
from rawscan.functions.bitmaps import bits_set, bits_text, bits_unset
from rawscan.plans import planner
from rawscan.plans.decompose import RawFilter, limit_fairly
from rawscan.plans.literals import is_sound_token
from rawscan.sources import byte_range, read_records, read_whole, write_records
from rawscan.streaming import recalibrating_writer, search_stream


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def trump():
    return JsonQuery().add_string_filter("text", contains("Trump"))


PASS = ['{"text":"Trump"}', '{"text":"Tr' + chr(92) + 'u0075mp"}', r'{"text":"a\u0000Trump"}', '{"text":"x","text":"Trump"}']
FAIL = [
    '{"text":"trump"}', '{"text":"x","other":"Trump"}', '{"Trump":1,"text":"x"}', '{"text":"Trump"} xyz', '{"text":"Trump"}{"a":1}', '{"text":"Trump"},{"a":1}',
    '{"text":"Trump"', "{'text':'Trump'}", "", "null", '"Trump"', '[{"text":"Trump"}]', '{"other":1}', '{"text":null}', '{"text":5}', '{"text":{"a":"Trump"}}',
    '{"text":["Trump"]}', '{"text":"Trump","text":"x"}', None,
]


def test_edge_records(spark):
    got = [r.value for r in search(frame(spark, PASS + FAIL), trump()).collect()]
    assert sorted(got) == sorted(PASS)


def test_raw_mode_loses_escaped_text(spark):
    assert search(frame(spark, PASS), trump(), mode="raw").count() == 3


def test_strict_refuses_bracket_junk(spark):
    rows = frame(spark, ['{"text":"Trump"}] z', '{"text":"Trump"}} z', '{"text":"Trump"}'])
    assert search(rows, trump(), strict=True).count() == 1
    assert search(rows, trump()).count() == 2


def test_typed_leaves(spark):
    ints = ['{"n":1}', '{"n":1.5}', '{"n":1.0}', '{"n":"5"}', '{"n":9223372036854775808}', '{"n":-3}']
    got = execute(frame(spark, ints), JsonQuery().add_integer_filter("n", lambda c: c > 0))
    assert [r.value for r in got.collect()] == ['{"n":1}']
    got = execute(frame(spark, ['{"b":true}', '{"b":"true"}', '{"b":false}']), JsonQuery().add_boolean_filter("b"))
    assert [r.value for r in got.collect()] == ['{"b":true}']


def test_first_key_wins_by_path(spark):
    got = execute(frame(spark, ['{"text":"Trump","text":"x"}', '{"text":"x","text":"Trump"}']), trump(), strategy="path")
    assert [r.value for r in got.collect()] == ['{"text":"Trump","text":"x"}']


def test_projections_and_existence(spark):
    rows = frame(spark, ['{"a":{"b":"x","f":1.5},"t":["p","q"],"n":null}', '{"a":{"b":"y"}}'])
    q = JsonQuery().add_exists("n").add_projection("a.b").add_projection("a.f", "double").add_projection("t", "array<string>")
    assert [tuple(r)[1:] for r in execute(rows, q).collect()] == [("x", 1.5, ["p", "q"])]


def test_builder_refuses_contradictions():
    with pytest.raises(ValueError):
        JsonQuery().add_string_filter("a", equals("x")).add_string_filter("a.b", equals("x"))
    with pytest.raises(ValueError):
        JsonQuery().add_string_filter("a.b", equals("x")).add_integer_filter("a", lambda c: c > 1)
    with pytest.raises(ValueError):
        JsonQuery().add_string_filter("a", equals("x")).add_integer_filter("a", lambda c: c > 1)
    with pytest.raises(ValueError):
        JsonQuery().add_string_filter("a..b", equals("x"))
    with pytest.raises(ValueError):
        JsonQuery().add_string_filter("a.K", equals("x")).add_string_filter("a.k", equals("x"))
    assert "a (type=object)" in JsonQuery().add_string_filter("a.b", equals("x")).describe()


def test_two_filters_on_a_path_are_both_needed(spark):
    q = JsonQuery().add_string_filter("t", startswith("ab")).add_string_filter("t", endswith("yz"))
    assert q.literals() == ["ab", "yz"]
    assert q.path_tokens() == ['"t"']
    assert search(frame(spark, ['{"t":"ab yz"}', '{"t":"ab"}']), q).count() == 1


def test_no_literals_from_unsound_predicates():
    q = JsonQuery().add_string_filter("a", contains('x"y')).add_string_filter("a", custom(lambda c: ~c.contains("z"))).add_integer_filter("n", equals(5))
    assert q.literals() == []
    assert not is_sound_token("a\nb") and not is_sound_token("\\") and is_sound_token("a/b")


def test_slash_guard(spark):
    rows = frame(spark, [r'{"t":"a\/b"}', '{"t":"a/b"}', '{"t":"ab"}'])
    assert search(rows, JsonQuery().add_string_filter("t", contains("a/b"))).count() == 2


def test_raw_filters_never_change_results(spark):
    rng = random.Random(5)
    alphabet = 'abc/"\\\nü'
    import json

    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = frame(spark, [json.dumps({"text": t}, ensure_ascii=rng.random() < 0.5) for t in texts])
    for _ in range(6):
        token = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 3)))
        q = JsonQuery().add_string_filter("text", contains(token))
        a, b = search(rows, q).count(), search(rows, q, raw_filter=False).count()
        assert a == b == sum(token in t for t in texts)


def test_one_parse_in_plan(spark):
    q = trump().add_string_filter("user.name", equals("x")).add_integer_filter("n", lambda c: c > 1).add_projection("user.name")
    plan = search(frame(spark, PASS), q)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@pytest.mark.parametrize(
    "terms, want",
    [
        (["Trump"], ["Trump", "Trum", "rump"]),
        (["Trump", "Putin"], ["Trump", "Trum", "rump", "Putin", "Puti", "utin"]),
        (["abcd", "efghi", "jk"], ["abcd", "efghi", "efgh", "fghi", "jk"]),
    ],
)
def test_decompose(terms, want):
    assert [f.token for f in decompose(terms)] == want


def test_planner_is_argmin():
    rng = random.Random(1)
    filters = decompose(["thatin", "onons", "xy"])
    patterns = {rng.getrandbits(len(filters)): rng.randrange(1, 9) for _ in range(40)}
    total = sum(patterns.values())

    def brute(combo):
        cost, alive = 0.0, dict(patterns)
        for i in combo:
            cost += 8.0 * len(filters[i].token) * sum(alive.values()) / total
            alive = {m: n for m, n in alive.items() if m >> i & 1}
        return cost + 300.0 * sum(alive.values()) / total

    combos = [c for k in range(5) for c in itertools.combinations(range(len(filters)), k) if len({filters[i].source for i in c}) == k]
    best, processed, skipped = planner.choose(filters, patterns, 300.0)
    assert processed == len(combos)
    assert best.cost == pytest.approx(min(map(brute, combos)))
    last, _, _ = planner.choose(decompose(["Trump", "Putin"]), {63: 1}, 1.0, policy="last_valid")
    assert last.indexes == (2, 5)


def test_planner_can_choose_no_filter(spark):
    plan = planner.calibrate(frame(spark, ["aa"] * 20), ["aa"], parse_cost=10.0)
    assert plan.tokens == [] and plan.schedule.cost == 10.0
    assert planner.calibrate(frame(spark, []), ["aa"], parse_cost=10.0).sampled == 0
    assert planner.calibrate(frame(spark, ["aa", "bb"]), ["aa"], sample="random").sampled == 2


def test_limit_is_fair():
    filters = [RawFilter(str(i), 0) for i in range(40)] + [RawFilter("x", 1), RawFilter("y", 1)]
    kept = limit_fairly(filters, 32)
    assert len(kept) == 32 and {"x", "y"} <= {f.token for f in kept}


def test_term_list_limits():
    terms = TermList()
    assert terms.add("a" * 20) == 1 and terms.terms == ["a" * 16]
    assert [terms.add("b") for _ in range(32)][-1] == -1


def test_stats_without_survivors(spark):
    row = stats(frame(spark, ["", "abc", "abd"]), ["ab", "zz"], F.lit(True)).first()
    assert (row.records, row.total_matches, row.rf_passed, row.fraction_passed_correct, row.fraction_passed_incorrect) == (3, 2, 0, 0.0, 0.0)
    assert stats_report(stats(frame(spark, ["x"]), ["x"], F.lit(True))).count() == 8


def test_sources(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\n\ntwo\n")
    assert [r.value for r in read_records(spark, str(tmp_path / "a")).collect()] == ["one", "", "two"]
    (tmp_path / "b").write_bytes(b"one\r\n")
    assert read_records(spark, str(tmp_path / "b")).first().value == "one\r"
    (tmp_path / "c").write_bytes(b"a;b;;c")
    assert read_records(spark, str(tmp_path / "c"), ";").count() == 4
    whole = read_whole(spark, str(tmp_path / "a"))
    assert bytes(byte_range(whole, 1, 4).first().value) == b"ne\n\n"
    write_records(frame(spark, ["p", "q"]), str(tmp_path / "out"))
    assert read_records(spark, str(tmp_path / "out")).count() == 2


def test_bits():
    assert bits_unset(bits_set(0, 1, 70), 70) == 2
    assert bits_text(5, 4) == "0101"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(PASS * 5 + [f for f in FAIL if f]))
    found = search_stream(spark, str(tmp_path / "in"), trump())
    run = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("found").count() == 20
    seen = []
    write = recalibrating_writer(trump(), lambda df, _: seen.append(df.count()), parse_cost=2000.0)
    raw = read_records(spark, str(tmp_path / "in"), streaming=True)
    raw.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sum(seen) == 20


def test_cli(spark):
    rows = frame(spark, ['{"text":"Trump Putin"}', '{"text":"Trump"}'])
    r = compare(rows, trump().add_string_filter("text", contains("Putin")))
    assert r["raw_filter"] == r["parser_only"] == 1
    assert "no such" in answer(rows, "0") and "no such" in answer(rows, "1x") and "1." in answer(rows, "queries")
    assert "parser only: 1" in answer(rows, "1")
