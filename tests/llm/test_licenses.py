"""Every license of a text, at each of its places."""

import random

import pytest

from statera.llm import license_align as L


def found(text, **more):
    return [(n, f, e) for n, _, f, e in L.all_notices(L.words(text), {n: L.words(t) for n, t in L.NOTICES.items()}, 0.8, **more)]


def test_every_notice_and_place(spark):
    mit, nc = L.NOTICES["MIT"], L.NOTICES["CC-BY-NC-4.0"]
    filler = "one two three four five six seven eight nine ten " * 9
    assert found(f"{filler} {mit} {filler} {nc} {mit} x {mit}") == [("MIT", 90, 95), ("CC-BY-NC-4.0", 185, 192), ("MIT", 192, 197), ("MIT", 198, 203)]
    both = f"{mit} {L.NOTICES['Apache-2.0-text']}"
    row = L.license_scan(spark.createDataFrame([(1, both)], "doc_id long, text string")).first()
    assert row.license == "Apache-2.0-text" and {x.license for x in row.found} == {"MIT", "Apache-2.0", "Apache-2.0-text"}


def test_the_distinguishing_words_are_needed(spark):
    others = ["Released under the BSD License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the Apache License, Version 1.1.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"]
    rows = list(enumerate([*others, *L.NOTICES.values()]))
    got = {r.doc_id: r.license for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(others))] == [None] * len(others)
    assert [got[i + len(others)] for i in range(len(L.NOTICES))] == list(L.NOTICES)


@pytest.mark.parametrize("name", list(L.NOTICES))
def test_insertions_of_any_length_against_the_whole_alignment(name):
    """No place may be covered less than by aligning the whole text."""
    rng = random.Random(name)
    notice, notices = L.words(L.NOTICES[name]), {name: L.words(L.NOTICES[name])}
    for inserted in (0, 1, 4, 8, 40, 400):
        text = list(notice)
        for _ in range(inserted):
            text.insert(rng.randrange(len(text) + 1), f"x{rng.randrange(50)}")
        for lost in range(int(0.2 * len(notice)) + 1)[:3]:
            for cut in (text, [w for i, w in enumerate(text) if i % 17 or not lost]):
                filler = [f"y{rng.randrange(300)}" for _ in range(rng.choice((0, 5, 1000)))]
                whole = filler + cut + filler
                want = len(L.align(notice, whole)) / len(notice)
                got = L.all_notices(whole, notices, 0.8)
                assert max((s for _, s, _, _ in got), default=0.0) >= (want if want >= 0.8 else 0.0)
    spread = [w for x in notice for w in (x, "xx", "yy")]
    twice = L.all_notices(spread + ["filler"] * 50 + spread, notices, 0.8)
    alone = len(L.align(notice, spread)) / len(notice)
    assert alone < 0.8 or len(twice) == 2 and min(s for _, s, _, _ in twice) >= alone and twice[0][3] <= twice[1][2]


def test_a_place_taken_leaves_the_rest():
    notice = L.words(L.NOTICES["MIT"])
    text = (["a"] * 30 + notice) * 25 + ["b"] * 30 + [w for x in notice for w in (x, "c")]
    got = L.all_notices(text, {"MIT": notice}, 0.8)
    assert len(got) == 26 and all(s == 1.0 for _, s, _, _ in got) and all(x[3] <= y[2] for x, y in zip(got, got[1:]))
