"""Readers that set malformed lines aside, and result rows in the types of their layout."""

import pytest

from ripplenet.sources import files

LINES = {
    "user_info": (
        ["f\tann\tnull\t1\t2\tc\td\ten\t3\tw\tt\tb\t4", "f\tbob\tParis\t\t\tc\td\ten\t\tw\tt\tb\t"],
        ["f\tann\tx\tmany\t2\tc\td\ten\t3\tw\tt\tb\t4", "one field", "f\tann\tx\t1\t2\tc\td\ten\t3\tw\tt\tb\t99999999999"],
        ["followers is no int: many", "1 fields in place of 13", "statuses is no int: 99999999999"],
    ),
    "timeline": (
        ["u\tc\td\t1\t2\tg\tr\t3\t4\ten\tp\t5\ttext \"as is\tTRUE\tfalse", "u\t\t\t\t\t\t\t\t\t\t\t\t\t\t"],
        ["u\tc\td\t1\t2\tg\tr\t3\t4\ten\tp\t5\tt\tmaybe\tfalse", "\t" * 15],
        ["sensitive is no boolean: maybe", "16 fields in place of 15"],
    ),
    "predictions": (["a\t1.0", "b\t"], ["a", "a\tb\tc"], ["1 fields in place of 2", "3 fields in place of 2"]),
    "labels": (["a\t1", "b\t"], ["a\tx", "a\t1\t"], ["label is no int: x", "3 fields in place of 2"]),
    "location_lookup": (["Nice, FR\tNICE"], ["Nice"], ["1 fields in place of 2"]),
    "state_lookup": (["Ohio\tOH"], ["Ohio\tOH\tUS"], ["3 fields in place of 2"]),
}
READERS = {
    "user_info": files.read_user_info, "timeline": files.read_timeline, "predictions": files.read_predictions,
    "labels": files.read_labels, "location_lookup": files.read_location_lookup, "state_lookup": files.read_state_lookup,
}


@pytest.mark.parametrize("layout", LINES)
def test_malformed_lines_are_set_aside(spark, tmp_path, layout):
    good, bad, reasons = LINES[layout]
    mixed, clean = tmp_path / "mixed", tmp_path / "clean"
    for folder, lines in ((mixed, [good[0], "", *bad, *good[1:]]), (clean, good)):
        folder.mkdir()
        (folder / "part.txt").write_text("\n".join(lines) + "\n")
    rows, rejected = files.read_with_rejects(spark, str(mixed), layout)
    want = READERS[layout](spark, str(clean))
    assert rows.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(tuple, rejected.collect())) == sorted(zip(bad, reasons))


def test_too_many_malformed_lines_stop_the_job(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("a\t1\n" + "b\n" * 5)
    assert files.read_with_rejects(spark, str(tmp_path), "labels", 5)[1].count() == 5
    with pytest.raises(ValueError, match="5 lines .* more than 4"):
        files.read_with_rejects(spark, str(tmp_path), "labels", 4)


def test_no_lines(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("")
    rows, rejected = files.read_with_rejects(spark, str(tmp_path), "labels")
    assert rows.count() == 0 and rejected.count() == 0


def test_types_of_results_do_not_follow_the_rows(spark, tmp_path):
    for layout, columns in files.RESULT_COLUMNS.items():
        (tmp_path / layout).mkdir()
        values = ["pooled" if c == "method" else "1" for c in columns]
        (tmp_path / layout / "rows.csv").write_text("\t".join(columns) + "\n" + "\t".join(values) + "\n")
        kinds = dict(files.read_results(spark, str(tmp_path / layout), layout).dtypes)
        assert list(kinds) == columns and kinds["mean"] == kinds["lmsiAll"] == "double" and kinds["wave"] == "int"


def test_catalog_names_and_rules():
    catalog = files.network_catalog("/data/", {"amazon": "raw", "enron": "simple"})
    assert catalog["amazon"] == files.Network("/data/com-amazon.ungraph.txt", "raw") and catalog["enron"].clean == "simple"
    assert catalog["epinions"].clean == "mutual" and "orkut" not in catalog and len(catalog) == 9
    for clean in ({"no such": "raw"}, {"amazon": "washed"}):
        with pytest.raises(ValueError):
            files.network_catalog("/data", clean)
