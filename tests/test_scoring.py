"""Skeletons, rules, classes, gates and joins."""

import io
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmere import cli
from glyphmere.functions import normalize as N
from glyphmere.functions import strings as S
from glyphmere.functions.tables import Sources, confusables, scripts
from glyphmere.plans.axes import AXES, NUMERIC, parse_fields, validate_metric
from glyphmere.plans.pairs import Config, score, similarity_join, watchlist

NAMES = ["lodash", "lodahs", "1odash", "lodash-utils", "my-lodash", "react", "reactive", "requests", "reqests", "python-requests", "rеquests", "google", "go0gle", "GO0GLE", "microsoft", "rnicrosoft", "foo_bar", "Foo.Bar", "py", "a" * 30, "vvallet", "wallet"]


def frame(spark, rows, schema="a string, b string"):
    return spark.createDataFrame(rows, schema)


def test_skeletons(spark):
    plain, wide = confusables(), confusables(Sources(True, True))
    assert plain.skeleton("microsoft") == "rnicrosoft" == plain.skeleton("rnicrosoft")
    assert plain.skeleton("xyz") == "xyz" and plain.skeleton("") == ""
    assert plain.skeleton("vv") != plain.skeleton("w") and wide.skeleton("vvallet") == wide.skeleton("wallet")
    assert wide.skeleton("nn") == wide.skeleton("m") and wide.skeleton("cl") == wide.skeleton("d")
    assert not plain.confusable("à", "a") and wide.confusable("à", "a")
    for x, y in ("1l", "0O", "Il"):
        assert plain.confusable(x, y)
    assert not plain.confusable("0", "o")
    names = frame(spark, [(x,) for x in [*NAMES, 'q"%`|1', "", None, "pаypal"]], "s string")
    for sources in (Sources(), Sources(True, True)):
        for r in names.select("s", S.skeleton(F.col("s"), sources).alias("k")).collect():
            assert r.k == (None if r.s is None else confusables(sources).skeleton(r.s))


def test_script_levels(spark):
    # fixed values
    want = {"paypal": 0, "pаypal": 4, "αβγ": 1, "日本の": 1, "a日本": 2, "aก": 3, "foo bar": 5, "foo/bar": 5, "foo-bar": 0, "": 0}
    assert {k: scripts().level(k) for k in want} == want
    got = frame(spark, [(k,) for k in want], "s string").select("s", S.restriction_level(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in got} == want


def test_rules(spark):
    def run(ops, *texts):
        return [r[0] for r in frame(spark, [(t,) for t in texts], "s string").select(N.normalized(F.col("s"), ops)).collect()]

    assert run(N.parse_rules('[["map","._-","-"]]'), "my---package", "my___package", "my.-_package") == ["my---package"] * 3
    assert run(N.parse_rules('[["collapse","-"]]'), "my---package", "my.-_package", "my___package") == ["my-package", "my.-_package", "my___package"]
    assert run(N.parse_rules('[["map",".",""],["map","_",":"]]'), "a.b", "a_b") == ["ab", "a:b"]
    assert run(N.PYPI, "requests_toolbelt", "Friendly.Bard", "FrIeNdLy-._.-bArD") == ["requests-toolbelt", "friendly-bard", "friendly-bard"]
    assert run(N.parse_rules('[["map","._-:","-"],["collapse",":"]]'), "foo:bar_baz") == ["foo-bar-baz"]
    assert run(N.parse_rules('[["map","^]\\\\","$1"]]'), "a^b]c\\d") == ["a$1b$1c$1d"]
    for bad in ("{}", '[["up"]]', '[["map","","x"]]', '[["map","a"]]', '[["lower"],]', "[[]]", '["lower"]'):
        with pytest.raises(ValueError):
            N.parse_rules(bad)


@pytest.mark.parametrize(
    "a, b, label",
    [  # fixed values
        ("lodash", "lodash", "identical"), ("lodash", "lodahs", "likely_typosquat"), ("lodash", "1odash", "likely_typosquat"),
        ("microsoft", "rnicrosoft", "likely_typosquat"), ("google", "go0gle", "likely_typosquat"), ("ab", "ac", "unrelated"),
        ("lodash", "lodash-utils", "possible_combosquat"), ("lodash", "my-lodash-utils", "possible_combosquat"),
        ("requests", "python-requests", "possible_combosquat"), ("react", "reactive", "unrelated"), ("lodash", "xylophone", "unrelated"),
    ],
)
def test_classes(spark, a, b, label):
    from glyphmere.functions.verdict import classified

    out = score(frame(spark, [(a, b)]), cfg=Config(fields="damerau,confusable_only,keyboard_distance"))
    got = out.select(classified(F.col("a") == F.col("b"), F.lit(False), *(F.col(c) for c in ("a", "b", "damerau", "confusable_only", "keyboard_distance")))[0]).first()[0]
    assert got == label


def test_verdicts(spark):
    for args, tag in ((["abc", "abc"], "IDENTICAL"), (["GOOGLE", "GO0GLE"], "LIKELY SPOOF"), (["rnicrosoft", "microsoft"], "LIKELY SPOOF"), (["google", "gogle"], "likely a typo"), (["apple", "xylophone"], "appear unrelated"), (["a0", "aOxyz"], "LIKELY BENIGN"), (["foo_bar", "foo-bar", "--pypi"], "SAME PROJECT")):
        out = io.StringIO()
        assert cli.main(args, spark, out) == 0
        assert tag in out.getvalue()


def test_registry():
    assert parse_fields("damerau, equal,equal,") == ["equal", "damerau"] and parse_fields("") == []
    assert len(AXES) == 10 and "equal" not in NUMERIC
    for bad in (lambda: parse_fields("nope"), lambda: validate_metric("equal"), lambda: Config(typosquat=True, threshold=1.0), lambda: Config(threshold=float("nan")), lambda: Config(top=0), lambda: Config(len_tolerance=2.0), lambda: Sources.parse("x")):
        with pytest.raises(ValueError):
            bad()


def test_null_pairs_have_null_axes(spark):
    r = score(frame(spark, [(None, "a"), ("a", None)])).collect()
    assert all(v is None for x in r for k, v in x.asDict().items() if k not in ("a", "b"))


def test_gate_keeps_what_is_kept_without_it(spark):
    names = frame(spark, [(x,) for x in NAMES], "value string")
    configs = [Config(typosquat=True), Config(typosquat=True, norm_ops=N.PYPI)]
    configs += [Config(fields=m, metric=m, threshold=float(t)) for m in ("damerau", "skeleton_damerau", "levenshtein", "skeleton_levenshtein", "keyboard_distance") for t in (0, 1, 2, 5)]
    for cfg, q in zip(itertools.cycle(configs), itertools.islice(itertools.cycle(["lodash", "requests", "rеquests", "microsoft", "py", "a" * 29]), len(configs) + 4)):
        rows = [sorted(map(repr, watchlist(names, q, cfg, gate=g).collect())) for g in (True, False)]
        assert rows[0] == rows[1], (cfg, q)


@pytest.mark.parametrize("cfg", [Config(typosquat=True), Config(typosquat=True, norm_ops=N.PYPI), Config(metric="damerau", threshold=2.0, fields="damerau"), Config(metric="skeleton_levenshtein", threshold=1.0, fields="skeleton_levenshtein"), Config(metric="levenshtein", threshold=4.0, fields="levenshtein"), Config(metric="damerau", threshold=3.0, fields="damerau", norm_ops=N.PYPI)])
def test_join_is_every_pair(spark, cfg):
    x, y = frame(spark, [(n,) for n in NAMES], "input string"), frame(spark, [(n,) for n in NAMES], "match string")
    every = frame(spark, list(itertools.product(NAMES, NAMES)), "input string, match string")
    want = score(every, "input", "match", cfg)
    assert sorted(map(repr, similarity_join(x, y, cfg).select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_join_is_one_shuffle_a_side(spark):
    x, y = frame(spark, [(n,) for n in NAMES], "input string"), frame(spark, [(n,) for n in NAMES], "match string")
    for cfg in (Config(typosquat=True), Config(typosquat=True, norm_ops=N.PYPI)):
        plan = similarity_join(x, y, cfg)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan and plan.count("Exchange ") <= 5
        assert plan.count("ArrowEvalPython") == 1  # the alignment, of what the gate lets through


def test_top_is_stable(spark):
    names = frame(spark, [("first", 1), ("secnd", 2), ("  x ", 3), ("", 4), (" ", 5)], "value string, ord long")
    got = watchlist(names, "x", Config(metric="levenshtein", fields="levenshtein", top=3)).collect()
    assert [r.match for r in got] == ["x", "first", "secnd"]


def test_plan_scores_once_and_gates_first(spark):
    names = frame(spark, [(x,) for x in NAMES], "value string")
    plan = watchlist(names, "lodash", Config(metric="damerau", threshold=1.0, fields="damerau"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.rindex("levenshtein")


def test_command_line(spark, tmp_path):
    (tmp_path / "names.txt").write_text("lodahs\r\n\n  xylophone \n")
    assert cli.main(["--string", "lodash", "--list", str(tmp_path / "names.txt"), "--typosquat"], spark, io.StringIO()) == 0
    assert cli.main(["--string", "zzz", "--list", str(tmp_path / "names.txt"), "-t", "0"], spark, io.StringIO()) == 1
    assert cli.main(["--string", "zzz", "--list", str(tmp_path / "nowhere.txt")], spark, io.StringIO()) == 2
    assert cli.main(["kitten", "sitting", "-t", "2"], spark, io.StringIO()) == 1
    for bad in (["a"], ["--list", "x"], ["--top", "0", "a", "b"], ["--pypi", "--pypi", "a", "b"], ["-q", "a"], ["--typosquat", "-t", "1", "a", "b"], ["-s", "a"], ["-n", str(tmp_path / "nowhere.json"), "a", "b"]):
        assert cli.main(bad, spark) == 2
    (tmp_path / "rules.json").write_text('[["lower"], ["map", "_", "-"]]')
    out = io.StringIO()
    assert cli.main(["-n", str(tmp_path / "rules.json"), "Foo_Bar", "foo-bar"], spark, out) == 0 and "SAME PROJECT" in out.getvalue()
    out = io.StringIO()
    assert cli.main(["-v"], spark, out) == 0 and "unicode" in out.getvalue()
    assert cli.main(["-h"], spark, out) == 0


def test_lines_are_answered_in_their_order_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(cli, "BATCH", 3)
    taken, out = [], io.StringIO()

    def lines():
        for x in ["lodash,1odash", "abc", "", "a,b,c", "xyz", "kitten\tsitting", "q,q"]:
            taken.append((x, len(out.getvalue().splitlines())))
            yield x + "\n"

    assert cli.main(["-s", "-t", "3"], spark, out, lines()) == 0
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("line") or f"{r['a']},{r['b']}" for r in got] == ["lodash,1odash", "abc", "a,b,c", "xyz", "kitten,sitting", "q,q"]
    assert dict(taken)["a,b,c"] == 2  # the first batch was answered before
    assert '"keyboard_distance":0.7776' in out.getvalue() and '"keyboard_distance":null' in out.getvalue() or '"keyboard_distance":0.0000' in out.getvalue()
    assert cli.main(["-s", "-t", "0"], spark, io.StringIO(), ["a,b", "malformed"]) == 1


def test_functions_in_sql(spark):
    from glyphmere.functions.strings import register

    register(spark)
    r = spark.sql("SELECT osa_damerau('ca', 'abc') AS d, osa_aligned('lodash', '1odash').keyboard_distance AS k, skeleton('pаypal') AS s, restriction_level('pаypal') AS l").first()
    assert (r.d, round(r.k, 4), r.s, r.l) == (3, 0.7776, "paypal", 4)


def test_composed_and_compatibility_characters(spark):
    table = confusables()
    fixed = {"\u00e7": "c\u0326", "\u011b": "\u0115", "\u01e7": "\u011f", "\uf900": "\u8c48", "\u2126": "\u03a9", "\u212a": "K", "\u0387": "\u00b7", "\u00e9": "\u00e9", "\u010d": "\u010d", "\u00cd": "\u00cd"}  # fixed values
    assert {c: table.of(c) for c in fixed} == fixed
    names = ["\u00e7a", "\u01ceb", "\uf900m", "m1l0|%", "vvcl", "\uff4d\uff4f\uff43", "", "\ufb01\U0001d5c6x"]
    for sources in (Sources(), Sources(flowcrypt=True, digraph=True)):
        got = frame(spark, [(x,) for x in names], "s string").select(S.skeleton(F.col("s"), sources)).collect()
        assert [r[0] for r in got] == [confusables(sources).skeleton(x) for x in names]


def test_long_strings():
    from glyphmere.functions import alignment

    a = "ab" * 20_000
    assert alignment.distances([a, "x"], [a[:35_000] + "zz", ""]).tolist() == [5_000, 1]
    rng = np.random.default_rng(0)
    pairs = [("".join(rng.choice(list("abc"), rng.integers(0, 9))), "".join(rng.choice(list("abc"), rng.integers(0, 9)))) for _ in range(300)]
    d = alignment.distances(*map(list, zip(*pairs)))
    x, y = alignment.codes([p for p, _ in pairs]), alignment.codes([q for _, q in pairs])
    assert d.tolist() == alignment.matrices(x[0], y[0])[np.arange(300), x[1], y[1]].tolist()


def test_stream_equals_batch(spark, tmp_path):
    from glyphmere.sources.readers import pairs
    from glyphmere.sources.writers import json_lines
    from glyphmere.streaming.feed import pair_stream, ranked_batches, start_json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("lodash,lodahs\nbad\nreact\treactive\ngoogle,go0gle\n")
    cfg = Config(typosquat=True)
    good, _ = pair_stream(spark, str(tmp_path / "in"), cfg)
    start_json(good, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch, bad = pairs(spark, str(tmp_path / "in"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(r.value for r in json_lines(score(batch, cfg=cfg)).collect())
    assert [r.line for r in bad.collect()] == ["bad"]
    seen = []
    ranked_batches(spark.readStream.text(str(tmp_path / "in")), "google", Config(metric="levenshtein", fields="levenshtein", top=1), str(tmp_path / "cp2"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert len(seen) == 1


def test_corpus_readers(spark, tmp_path):
    from glyphmere.functions.tables import confusables_from_text, flowcrypt_from_json
    from glyphmere.sources import readers as R

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {r.value for r in R.pypi_index(spark, put("p.json", '{"projects":[{"name":"a"},{"name":"b"}]}')).collect()} == {"a", "b"}
    assert {r.value for r in R.npm_names(spark, put("n.json", '["x","y"]')).collect()} == {"x", "y"}
    assert R.top_packages(spark, put("t.json", '{"rows":[{"project":"a","download_count":3}]}')).first().download_count == 3
    assert R.labelled_pairs(spark, put("l.csv", "malicious_package,target_package,ecosystem,registry,classification,source\nreqests,requests,python,pypi,typo,x\n")).first().classification == "typo"
    assert R.malicious_names(spark, put("m.json", '{"affected":[{"package":{"name":"z"}}]}')).first().value == "z"
    rows = confusables_from_text(spark, put("c.txt", "# v\n0031 ;\t006C ;\tMA # x\n0031 ; 006C ; MA\n0041 0042 ; 0043 ; MA\n006D ; 0072 006E ; MA\n")).collect()
    assert {r.cp: list(r.points) for r in rows} == {0x31: [0x6C], 0x6D: [0x72, 0x6E]}
    got = flowcrypt_from_json(spark, put("f.json", '{"characters":{"a":[{"char":"à"},{"char":"b"}],"0":[{"char":"à"},{"char":"О"}]}}'), confusables()).collect()
    assert {chr(r.cp): r.skeleton for r in got} == {"à": "O", "О": "O"}
