"""Robots rules, intervals with points, and updates in turn, against plain Python."""

import random
import re

import pytest

from attestra.operators import control, intervals, robots


def plain_robots(text, agent, path):
    groups, names, rules = [], [], None
    for line in re.split("\r\n|\r|\n", text or ""):
        name, _, value = re.sub("#.*", "", line).strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if rules is not None:
                groups.append((names, rules))
                names, rules = [], None
            names.append(value.lower())
        elif name in ("allow", "disallow") and names:
            rules = rules if rules is not None else []
            if value:
                rules.append((name == "allow", value))
    groups.append((names, rules or []))
    who = agent if any(agent in n for n, _ in groups) else "*"
    best = (0, True)
    for names, rules in groups:
        for allow, rule in rules if who in names else ():
            pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + (r"\Z" if rule.endswith("$") else "")
            if re.match(pattern, path or "/", re.S):
                best = max(best, (len(rule), allow))
    return "ALLOW" if best[1] else "DENY"


FILES = [
    "", None, "Disallow: /\nUser-agent: *\n", "User-agent: *\nDisallow:\n", "User-agent: *\nDisallow: /", "User-agent: me\nUser-agent: you\nDisallow: /a\nAllow: /a/b\nUser-agent: *\nDisallow: /x", "user-agent: ME # it is\r\nDISALLOW: /*.php$\r\nallow: /a.php\r\n",
    "User-agent: *\nDisallow: /a+b(c)\nDisallow: /p$q\nAllow: /*/deep$", "User-agent: *\nAllow: /same\nDisallow: /same\nDisallow: /*same", "User-agent: me\nCrawl-delay: 1\n\nUser-agent: *\nDisallow: /", "User-agent: *\nDisallow: /a\nnonsense\nUser-agent: me\nDisallow: /b\nUser-agent: *\nDisallow: /c",
]
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/x", "/z.php", "/z.php?q=1", "/a.php", "/a+b(c)d", "/aab", "/p$q", "/p", "/same", "/not/same", "/q/deep", "/q/deep/er", "/b", "/c"]


def test_robots_rules_are_those_of_a_plain_matcher(spark):
    files = [(f"h{i}", 200, t) for i, t in enumerate(FILES)] + [("gone", 404, "User-agent: *\nDisallow: /"), ("shut", 401, ""), ("down", 503, None)]
    urls = [(k, f"h{i}", p) for k, (i, p) in enumerate((i, p) for i in range(len(FILES)) for p in PATHS)] + [(9001, "gone", "/"), (9002, "shut", "/"), (9003, "down", "/"), (9004, "unknown", "/")]
    got = robots.robots_allowed(spark.createDataFrame(urls, "url_id long, origin string, path string"), spark.createDataFrame(files, "origin string, status int, text string"), "Me/2.0")
    said = {r.url_id: r.verdict for r in got.collect()}
    assert len(said) == len(urls)
    for k, origin, path in urls[:-4]:
        assert said[k] == plain_robots(FILES[int(origin[1:])], "me", path), (FILES[int(origin[1:])], path)
    assert [said[9001 + i] for i in range(4)] == ["ALLOW", "DENY", "ERROR", "ERROR"]


@pytest.mark.parametrize("low,high", [(0, 1), (0, 40), (-1000, 1000), (10**12, 10**12 + 5000)])
def test_points_in_intervals(spark, low, high):
    rnd = random.Random(low + high)
    end = lambda: None if rnd.random() < 0.15 else rnd.randint(low - 5, high + 5)
    rows = [(i, end(), end()) for i in range(150)]
    points = [(i, rnd.randint(low, high)) for i in range(60)] + [(60, None), (61, low), (62, high)]
    frames = spark.createDataFrame(rows, "id long, start long, stop long"), spark.createDataFrame(points, "point_id long, at long")
    got = intervals.points_in(*frames)
    assert sorted(map(tuple, got.collect())) == sorted((i, p) for i, a, b in rows for p, at in points if at is not None and (a is None or a <= at) and (b is None or b >= at))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_no_points_and_no_intervals(spark):
    rows, points = spark.createDataFrame([(1, 0, 9)], "id long, start long, stop long"), spark.createDataFrame([(1, 5)], "point_id long, at long")
    assert intervals.points_in(rows, points.where("false")).count() == 0 and intervals.points_in(rows.where("false"), points).count() == 0


def test_updates_apply_one_after_the_other(spark):
    rnd = random.Random(8)
    current = [(i, rnd.randint(0, 3), f"s{i}") for i in range(20)]
    updates = [(rnd.randint(0, 24), k, rnd.choice([0, 1, 2, 3, 4, 5, None]), f"u{k}") for k in range(300)]
    now, states, wanted = {i: r for i, r, _ in current}, {i: s for i, _, s in current}, {}
    for i, k, expected, state in sorted(updates, key=lambda u: u[1]):
        if i not in now:
            wanted[k] = ("NOT_FOUND", None)
            continue
        outcome = "APPLIED" if expected == now[i] else "STALE" if expected is not None and expected < now[i] else "AHEAD"
        if outcome == "APPLIED":
            now[i], states[i] = now[i] + 1, state
        wanted[k] = (outcome, now[i])
    out, after = control.applied_in_turn(spark.createDataFrame(current, "id long, revision long, state string"), spark.createDataFrame(updates, "id long, seq long, expected long, state string"))
    assert {r.seq: (r.outcome, r.revision) for r in out.collect()} == wanted
    assert {r.id: (r.revision, r.state) for r in after.collect()} == {i: (now[i], states[i]) for i in now}
