import os

import pytest

from liftlake.sources import page_files as pf
from liftlake.sources.sinks import scratch_path


def land(path, name, text, at=None):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)
    if at is not None:
        os.utime(f"{path}/{name}", (at, at))


def page(n, count, items, key="routine_folders"):
    return f'{{"page":{n},"page_count":{count},"{key}":[{",".join(items)}]}}'


def ten(a):
    return [f'{{"id":"{i}"}}' for i in range(a, a + 10)]


def report(pages, entity="routine_folders"):
    return sorted((r.problem, r.page or -1, r.kept) for r in pf.page_report(pages, entity).collect())


def test_lines_and_whole_files_give_the_same_items(spark):
    lines, files = scratch_path(spark, "t-lines"), scratch_path(spark, "t-files")
    pages = [page(1, 2, ten(0)), page(2, 2, ten(10)[:3])]
    land(lines, "a.jsonl", "\n".join(pages) + "\n\n")
    for i, p in enumerate(pages):
        land(files, f"{i}.json", p.replace(",", ",\n  ").replace("[", "[\n"))
    got = [sorted((r.page, r.item) for r in pf.page_items(pf.read_pages(spark, d, "routine_folders", m)).collect()) for d, m in ((lines, False), (files, True))]
    assert got[0] == got[1] and len(got[0]) == 13
    assert report(pf.read_pages(spark, files, "routine_folders", True)) == []


def test_broken_pages_are_reported_and_the_others_read(spark):
    d = scratch_path(spark, "t-broken")
    whole = page(1, 8, ten(0))
    land(d, "a.jsonl", "\n".join([
        whole, whole[: len(whole) // 2], '{"page":2,"page_count":8,"error":"timeout"}', '{"page":3,"page_count":8,"routine_folders":{"id":1}}',
        '{"page":3,"page_count":8,"routine_folders":null}', page('"4x"', 8, ten(30)), page(0, 8, ten(30)), "not json", "[1,2]", page(5, 8, ten(40)[:4]),
        page(6, 8, []), page(9, 8, ten(80)), "   ",
    ]))
    pages = pf.read_pages(spark, d, "routine_folders")
    assert report(pages) == sorted([
        ("unreadable", 1, False), ("no item list", 2, False), ("no item list", 3, False), ("no item list", 3, False), ("no page number", -1, False),
        ("no page number", -1, False), ("unreadable", -1, False), ("no item list", -1, False), ("short", 5, True), ("short", 6, True),
        ("past the end", 9, True), ("missing", 2, False), ("missing", 3, False), ("missing", 4, False), ("missing", 7, False), ("missing", 8, False),
    ])
    items = pf.page_items(pages).collect()
    assert sorted(r.page for r in items) == [1] * 10 + [5] * 4 + [9] * 10
    broken = {r.raw for r in pages.where("problem IS NOT NULL").collect()}
    assert "not json" in broken and whole not in broken


def test_the_copy_that_landed_last_counts(spark):
    d = scratch_path(spark, "t-copies")
    land(d, "z.jsonl", page(1, 2, ten(0)) + "\n" + page(2, 2, ten(10)[:1]), at=1_000)
    land(d, "a.jsonl", page(1, 2, ten(50)), at=2_000)
    land(d, "b.jsonl", page(1, 2, ten(90)) + "\n" + page(1, 2, ten(90)), at=1_500)
    pages = pf.read_pages(spark, d, "routine_folders")
    found = pf.item_provenance(pages).collect()
    assert {r.item for r in found if r.page == 1} == set(ten(50)) and len(found) == 11
    assert {r.file.rsplit("/", 1)[1] for r in found} == {"a.jsonl", "z.jsonl"}
    assert [(r.position, r.item) for r in sorted(found, key=lambda r: r.position) if r.page == 1][3] == (3, ten(50)[3])
    assert report(pages) == [("repeated", 1, False)] * 3


def test_missing_pages_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(pf, "NUMBERS_A_TASK", 4)
    d = scratch_path(spark, "t-missing")
    land(d, "a.jsonl", "\n".join(page(n, 19, ten(0)) for n in (1, 4, 5, 8, 9, 16, 18)))
    got = sorted(r.page for r in pf.missing_pages(pf.read_pages(spark, d, "routine_folders")).collect())
    assert got == [2, 3, 6, 7, 10, 11, 12, 13, 14, 15, 17, 19]


def test_an_empty_folder_has_no_pages(spark):
    d = scratch_path(spark, "t-none")
    land(d, "a.jsonl", "\n")
    pages = pf.read_pages(spark, d, "events")
    assert pages.count() == 0 and report(pages, "events") == []


@pytest.mark.parametrize("number", [3 * 10**10, 10**17])
def test_page_numbers_beyond_an_int(spark, number):
    d = scratch_path(spark, "t-long")
    land(d, "a.jsonl", page(number, 1, ten(0)))
    assert {r.page for r in pf.page_items(pf.read_pages(spark, d, "routine_folders")).collect()} == {number}


def test_blank_lines_are_found_by_their_first_other_character(spark):
    """A page's text is not copied to find out whether something is in it."""
    d = scratch_path(spark, "t-blank")
    body = '{"page":1,"page_count":1,"events":["%s"]}'
    spark.createDataFrame([(body % "a",), ("",), ("   ",), (" \r ",), ("\t",), (" ",), ("  " + body % "b",)], "value string").coalesce(1).write.text(d)
    pages = pf.read_pages(spark, d, "events")
    assert sorted((r.problem or "", r.raw or "") for r in pages.collect()) == [("", ""), ("", ""), ("unreadable", "\t"), ("unreadable", " ")]
    assert "regexp_replace" not in pages._jdf.queryExecution().optimizedPlan().toString()
