"""Arrays cut at every place give the elements that reading them whole gives."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from threadhaul.sources import json_split as J
from threadhaul.sources.files import scan_wildcard_files
from threadhaul.sources.roster import roster_rows, roster_rows_from_elements

AWKWARD = (
    '/* [{ " */ [ {"DisplayName": "a\\\\", "x": "}],[{" , "ExternalDirectoryObjectId":"1"},// }"\n'
    '{"DISPLAYNAME":"q\\"}", "n": {"m": [1, {"k": "/*"}]}, "externaldirectoryobjectid": "é😀2"} /**/ ,\n'
    '{"a": "\\\\\\"," , "ExternalDirectoryObjectId": "//3"}, {}, /* , */ {"ExternalDirectoryObjectId":"4"} /* ** } **/ ] // ]}'
)


def cut_at(text, places):
    """The elements of `text` as blocks that begin at `places` give them."""
    borders = [0, *sorted(places), len(text)]
    blocks = [text[a:b] for a, b in zip(borders, borders[1:])]
    state, depth, out, open_ = J.PLAIN, 0, [], None
    closed = 0
    for block in blocks:
        table = J.block_table(iter([block]))
        assert table == J.block_table(iter([block[: len(block) // 3], block[len(block) // 3 :]]))
        cutter = J.Cutter("f", state, depth)
        for part in (block[: len(block) // 2], block[len(block) // 2 :]):
            cutter.add(part)
        state, depth = table[state][0], depth + table[state][1]
        rows = list(cutter.rows())
        for kind, _, found in sorted(rows, key=lambda r: {3: 0, 1: 0, 0: 1, 2: 2, 4: 3}[r[0]]):
            if kind == 0:
                out.append(found)
            elif kind == 4:
                closed += 1
            elif kind == 2:
                open_ = found
            else:
                open_ += found
                if kind == 1:
                    out.append(open_)
    assert closed == 1
    return [x for x in out if not J.blank(x)]


def test_every_cut_of_an_awkward_array():
    want = cut_at(AWKWARD, [])
    assert len(want) == 5
    for place in range(len(AWKWARD)):
        assert cut_at(AWKWARD, [place]) == want, place
    rng = random.Random(1)
    for _ in range(300):
        assert cut_at(AWKWARD, [rng.randrange(len(AWKWARD)) for _ in range(rng.randrange(2, 30))]) == want


def test_random_arrays_and_cuts():
    rng = random.Random(4)
    letters = ['"', "\\", "/", "*", "{", "}", "[", "]", ",", "a", "\n", "é"]

    def value(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        if kind == 4:
            return {"".join(rng.choice(letters) for _ in range(3)): value(depth - 1) for _ in range(rng.randrange(3))}
        return rng.choice([1, None, "".join(rng.choice(letters) for _ in range(rng.randrange(9)))])

    for _ in range(200):
        objects = [{"k": value(3), "l": value(2)} for _ in range(rng.randrange(6))]
        text = json.dumps(objects, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))
        cuts = [rng.randrange(len(text)) for _ in range(rng.randrange(9))]
        assert [json.loads(x) for x in cut_at(text, cuts)] == objects


@pytest.fixture
def small_blocks(spark):
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "97")
    yield
    spark.conf.set(size, before)


def rows(frame):
    columns = [c for c in frame.columns if c not in ("block_start", "position")]
    found = frame.orderBy("file_path", "block_start", "position").select(*columns).collect()
    return [tuple(r) for r in found]


def test_split_files_equal_whole_files(spark, tmp_path, small_blocks):
    folder = tmp_path / "r"
    (folder / "sub").mkdir(parents=True)
    rng = random.Random(9)
    many = [{"DisplayName": f"n{i}", "ExternalDirectoryObjectId": str(i) * rng.randrange(1, 60), "o": {"p": ["}", i]}} for i in range(100)]
    (folder / "AllMailBoxes 1.json").write_text(json.dumps(many))
    (folder / "sub" / "AllMailBoxes+2.json").write_text(AWKWARD)
    (folder / "AllMailBoxes3.json").write_text("[]")
    (folder / "AllMailBoxes4.json").write_text(json.dumps([{"ExternalDirectoryObjectId": "x" * 5000}], indent=2))
    (folder / "other.json").write_text("{}")
    want = rows(roster_rows(scan_wildcard_files(spark, str(folder), "*AllMailBoxes*.json")))
    elements = J.array_elements(spark, str(folder), "*AllMailBoxes*.json")
    assert len(want) == 106 and rows(roster_rows_from_elements(elements)) == want
    # Many tasks have had a part of the large file.
    assert elements.where("file_path LIKE '%1.json'").select("block_start").distinct().count() > 30


def test_small_blocks_share_tasks(spark, tmp_path, small_blocks):
    """Hundreds of blocks are no hundreds of tasks, and the session's settings stay as they were."""
    many = [{"DisplayName": f"n{i}", "ExternalDirectoryObjectId": str(i)} for i in range(1000)]
    for number in range(3):
        (tmp_path / f"a{number}.json").write_text(json.dumps(many))
    elements = J.array_elements(spark, str(tmp_path), "*")
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
    assert elements.select("file_path", "block_start").distinct().count() > 1000
    # One file of parts per task.
    assert len(elements.inputFiles()) <= 2 * J._TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = [tuple(r) for r in roster_rows_from_elements(elements).groupBy("ExternalDirectoryObjectId").count().collect()]
    assert sorted(found) == sorted((str(i), 3) for i in range(1000))


@pytest.mark.parametrize("text", ["{}", "5", '"x"', "[1", "[{}", '[{"a":1}\n', "[] []", "[]]", "x []", "[] x", '["a', "/* [] */", " \n "])
def test_files_that_are_no_array(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises((ValueError, PySparkException), match="not a JSON array"):
        J.array_elements(spark, str(tmp_path), "*").collect()


def test_null_elements(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"ExternalDirectoryObjectId":"1"}, null]')
    elements = J.array_elements(spark, str(tmp_path), "*")
    with pytest.raises(PySparkException, match="null roster object"):
        roster_rows_from_elements(elements).collect()
    assert [r.ExternalDirectoryObjectId for r in roster_rows_from_elements(elements, strict=False).orderBy("position").collect()] == ["1", None]


def test_export_of_a_large_roster(spark, store, settings, pages, roster_folder, small_blocks):
    import dataclasses

    from threadhaul import schemas as S
    from threadhaul.plans.export import ChatExport, landed_pages_reader

    folder = roster_folder(*(f"u{n}" for n in range(50)))
    landed = pages.frame(spark, [pages.page("u1", 0, [pages.message("1")])])
    ChatExport(spark, dataclasses.replace(settings, roster_split_bytes=100)).run(folder, landed_pages_reader(landed))
    assert store.read(S.ROSTER_TABLE).count() == 50
