"""Delimited files with awkward traits, written by the test itself."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.plans.files import audit_files, load_catalogue
from plumbline.sources import catalogue, delimited, results, streamed

SECTORS = [("Alpha", "alpha", "ALP"), ("Beta", "beta", "BET"), ("Gone", "gone", "GON")]

FILES = {
    "alpha/01 bom and thousands.csv": '﻿#,Name,Amount\r\n1,one,"1,173,910"\r\n2,two,"2,000"\r\n'
    '3,three,N/A\r\n'.encode(),
    "alpha/02 semicolons.CSV": b"id;v;when\n1;1.5;2024-01-01\n2;;2024-02-01\n3;2.5;2024-03-01\n",
    "alpha/03 tabs.csv": b"a\tb\n1\tx\n2\ty\n",
    "alpha/04 pipes.csv": b"a|b\n1|x\n2|-\n",
    "alpha/05 one column.csv": b"only\n1\n2\n2\n",
    "alpha/06 header only.csv": b"a,b\n",
    "alpha/07 empty.csv": b"",
    "alpha/ignored.txt": b"a,b\n1,2\n",
    "beta/1 quoted breaks.csv": b'"first\nname",second,third\n"x\ny",1,\n"z ""q""",2,\n\n"w",3,\n',
    "beta/2 ragged.csv": b"a,b,c\n1,2,3\n4,5\n6,7,8,9\n1,2,3,\n7,8,9\n",
    "beta/3 arabic.csv": "رقم,اسم\n1,نعم\n2,لا\n".encode("windows-1256"),
    "beta/4 repeated names.csv": b"n,n,,n\n1,2,3,4\n",
    "beta/5 types.csv": b"flag,year,lunar,code\nTrue,2020,1441,007\nFalse,2021,1442,5d\n",
    "beta/6 [odd] {name}*.csv": b"a,b\n1,2\n",
    # The first 65,536 bytes end inside a character, or inside the header.
    "beta/7 long.csv": ("ab,b\n" + "é" * 40_000 + ",1\n" + "x,2\n").encode(),
    "beta/8 long header.csv": ('"' + "é\n" * 30_000 + '",b\n1,2\n').encode(),
    "beta/90 unicode.csv": "a\tb\n1\tüñ\n2\tنعم\n".encode("utf-16"),
    "beta/91 big endian.csv": b"\xfe\xff" + "a,b\n1,é\n".encode("utf-16-be"),
    "beta/92 flags with a gap.csv": b"flag,n\nTrue,1\n,2\nFalse,3\n",
    "beta/93 large integers.csv": b"n,m\n9007199254740992,1\n9007199254740993,1\n09007199254740993,1\n",
    "beta/94 odd flags.csv": b"flag,n\ntRuE,1\nfalse,2\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogue")
    for name, content in FILES.items():
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    return str(folder)


@pytest.fixture(scope="module")
def loaded(spark, root):
    return load_catalogue(spark, root, SECTORS)


@pytest.fixture(scope="module")
def inventory(loaded):
    return {r.file_name: r for r in loaded.inventory().collect()}


@pytest.fixture(scope="module")
def stats(loaded):
    names = {r.dataset_id: r.file_name for r in loaded.files.collect()}
    return {(names[r.dataset_id], r.col_idx): r for r in loaded.stats.collect()}


def test_ids_follow_names_within_a_sector(inventory):
    assert [inventory[n].dataset_id for n in sorted(inventory) if n[0] == "0"] == [
        f"ALP-0{i}" for i in range(1, 8)
    ]
    assert "ignored.txt" not in inventory and len(inventory) == 20


def test_failed_file_keeps_its_place(inventory):
    row = inventory["07 empty.csv"]
    assert (row.dataset_id, row.load_ok) == ("ALP-07", False)
    assert row.error and row.rows is None


def test_utf_16(loaded, inventory):
    for name, delimiter, rows in (("90 unicode.csv", "\t", 2), ("91 big endian.csv", ",", 1)):
        row = inventory[name]
        assert (row.encoding, row.delimiter, row.rows, row.cols) == ("utf-16", delimiter, rows, 2)
    cells = {tuple(r.cells) for r in loaded.cells.where(F.col("dataset_id") == inventory["90 unicode.csv"].dataset_id).collect()}
    assert cells == {("1", "üñ"), ("2", "نعم")}


def test_flags_and_large_integers(spark, root, loaded, stats, inventory):
    assert (stats["92 flags with a gap.csv", 0].col_type, stats["92 flags with a gap.csv", 0].is_numeric) == ("string", False)
    assert (stats["94 odd flags.csv", 0].col_type, stats["94 odd flags.csv", 0].is_numeric) == ("string", False)
    assert stats["5 types.csv", 0].col_type == "boolean"
    counts = {r.dataset_id: r for r in delimited.cell_row_counts(loaded.cells, loaded.stats).collect()}
    row = counts[inventory["93 large integers.csv"].dataset_id]
    assert (row.total_rows, row.distinct_rows) == (3, 2)


def test_digest_and_size(inventory):
    for name, content in FILES.items():
        file_name = name.split("/")[1]
        if file_name in inventory:
            row = inventory[file_name]
            assert row.sha256 == hashlib.sha256(content).hexdigest()
            assert row.size_kb == round(len(content) / 1024, 1)


@pytest.mark.parametrize(
    "name, encoding, delimiter, rows, cols",
    [
        ("01 bom and thousands.csv", "utf-8-sig", ",", 3, 3),
        ("02 semicolons.CSV", "utf-8", ";", 3, 3),
        ("03 tabs.csv", "utf-8", "\t", 2, 2),
        ("04 pipes.csv", "utf-8", "|", 2, 2),
        ("05 one column.csv", "utf-8", ",", 3, 1),
        ("06 header only.csv", "utf-8", ",", 0, 2),
        ("1 quoted breaks.csv", "utf-8", ",", 3, 3),
        ("2 ragged.csv", "utf-8", ",", 3, 3),
        ("3 arabic.csv", "windows-1256", ",", 2, 2),
        ("4 repeated names.csv", "utf-8", ",", 1, 4),
        ("6 [odd] {name}*.csv", "utf-8", ",", 1, 2),
        ("7 long.csv", "utf-8", ",", 2, 2),
        ("8 long header.csv", "utf-8", ",", 1, 2),
    ],
)
def test_shape(inventory, name, encoding, delimiter, rows, cols):
    row = inventory[name]
    assert (row.encoding, row.delimiter, row.rows, row.cols) == (encoding, delimiter, rows, cols)
    assert row.total_cells == rows * cols and row.load_ok and row.error is None


def test_header_names(stats):
    assert [stats["4 repeated names.csv", i].col_name for i in range(4)] == [
        "n",
        "n.1",
        "Unnamed: 2",
        "n.2",
    ]
    assert stats["1 quoted breaks.csv", 0].col_name == "first\nname"
    assert stats["3 arabic.csv", 1].col_name == "اسم"
    assert stats["01 bom and thousands.csv", 0].col_name == "#"


def test_types(stats):
    types = {key: row.col_type for key, row in stats.items()}
    assert types["01 bom and thousands.csv", 0] == "bigint"
    assert types["01 bom and thousands.csv", 2] == "string"  # thousands separators stay text
    assert types["02 semicolons.CSV", 1] == "double"
    assert [types["5 types.csv", i] for i in range(4)] == ["boolean", "bigint", "bigint", "string"]
    assert stats["1 quoted breaks.csv", 2].is_numeric  # nothing but nulls
    assert not stats["06 header only.csv", 0].is_numeric


def test_cells(loaded):
    names = {r.dataset_id: r.file_name for r in loaded.files.collect()}
    rows = {}
    for r in loaded.cells.orderBy("dataset_id", "row_id").collect():
        rows.setdefault(names[r.dataset_id], []).append(r.cells)
    assert rows["1 quoted breaks.csv"] == [["x\ny", "1", None], ['z "q"', "2", None], ["w", "3", None]]
    assert rows["2 ragged.csv"] == [["1", "2", "3"], ["4", "5", None], ["7", "8", "9"]]
    assert rows["3 arabic.csv"] == [["1", "نعم"], ["2", "لا"]]
    assert rows["01 bom and thousands.csv"][2] == ["3", "three", None]


def test_classes(inventory):
    row = inventory["5 types.csv"]
    assert (row.numeric_cols, row.categorical_cols, row.date_cols, row.freetext_cols) == (2, 1, 1, 0)
    assert inventory["02 semicolons.CSV"].date_cols == 1
    assert inventory["06 header only.csv"].categorical_cols == 2


def test_whole_audit_and_result_files(spark, root, tmp_path):
    _, audit = audit_files(spark, root, SECTORS)
    scores = {r.file_name: r for r in audit.scores.collect()}
    assert len(scores) == 19
    empty = scores["06 header only.csv"]
    assert (empty.completeness, empty.consistency, empty.uniqueness) == (0.0, 0.0, 0.0)
    assert scores["04 pipes.csv"].consistency == 0.5
    assert scores["05 one column.csv"].uniqueness == pytest.approx(2 / 3)
    assert all(s.timeliness is not None and not s.if_applicable for s in scores.values())

    folder = str(tmp_path / "results")
    names = results.write_audit(audit, folder)
    assert "if_dbscan_agreement" not in names and "gap_register" in names
    back = results.load_results(spark, folder)
    assert back["dataset_scores"].schema == schemas.DATASET_SCORES
    assert back["dataset_scores"].count() == 19
    assert back["if_contamination_sweep"].count() == 95
    assert back["if_dbscan_agreement"].isEmpty()
    assert back["headline"].first().n_datasets == 19
    with pytest.raises(FileNotFoundError):
        results.load_results(spark, str(tmp_path / "nothing"))


def test_missing_root(spark, tmp_path):
    with pytest.raises(ValueError):
        catalogue.scan_catalogue(spark, str(tmp_path), SECTORS)


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.sha256"
    path.write_text(f"{'a' * 64}  one.csv\n{'B' * 64} *two words.csv\n{'c' * 64}  gone.csv\nnoise\n")
    manifest = catalogue.read_manifest(spark, str(path))
    files = spark.createDataFrame(
        [("one.csv", "a" * 64), ("two words.csv", "d" * 64), ("new.csv", "a" * 64)],
        "manifest_path string, sha256 string",
    )
    checked = catalogue.check_manifest(files, manifest)
    status = {r.manifest_path: r.status for r in checked.collect()}
    assert status == {
        "one.csv": "ok",
        "two words.csv": "changed",
        "gone.csv": "missing",
        "new.csv": "extra",
    }
    same = catalogue.identical_files(files).first()
    assert (same.copies, same.first_path) == (2, "new.csv")


def test_streamed_files_look_like_whole_ones(spark, root):
    found = catalogue.scan_catalogue(spark, root, SECTORS)
    columns = ["file_name", "sha256", "encoding", "delimiter", "column_names", "load_ok", "error"]

    def looked(streamed_bytes):
        rows = delimited.sniff_files(spark, found, streamed_bytes).select(*columns).collect()
        return {r.file_name: r for r in rows}

    assert looked(200_000) == looked(1 << 40)


@pytest.mark.parametrize(
    "content, encoding",
    [
        (b"a,b\n1,2\n", "utf-8"),
        (b"a,b\r1,2\r" * 9, "utf-8"),  # no line feed at all
        (b"\xef\xbb\xbfa,b\n1,2", "utf-8-sig"),
        (b"\xef\xbb\xbfa,b\n1,2\n\n", "utf-8-sig"),
        (b"\n\na;b\n\xe9;2\n\n\n", "windows-1256"),
        ("a\tb\n1\té\n".encode("utf-16"), "utf-16"),
        (b"a,b\n" + b"x" * 300_000 + b",1\n", "utf-8"),  # a run beyond the bound
        (b"a,b\n" + b"x" * 300_000 + b"\xc3", "windows-1256"),
    ],
)
def test_streamed_bytes(spark, tmp_path, content, encoding):
    content += b"3,4\n" * 60_000 if encoding != "utf-16" else "3\t4\n".encode("utf-16-le") * 30_000
    (tmp_path / "one [x].csv").write_bytes(content)
    (tmp_path / "small.csv").write_bytes(b"a,b\n")
    found, uncut = streamed.streamed_files(spark, [str(tmp_path)], 100_000)
    row = found.collect()
    assert [(r.sha256, r.encoding) for r in row] == [(hashlib.sha256(content).hexdigest(), encoding)] and uncut == []


def test_load_metadata(loaded):
    row = results.load_metadata(loaded.inventory(), "ALP-02").first()
    assert (row.encoding, row.delimiter, row.rows, row.cols) == ("utf-8", ";", 3, 3)
    assert row.loaded_at is not None


def test_texts_stay_where_they_are_read(spark, tmp_path):
    from checks.queries import documents_by_sector

    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat(sha2(string(id), 512), 4) AS text", "concat('src', id % 20) AS source"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = documents_by_sector(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_coded_texts_fill_files_of_bounded_size(spark, monkeypatch):
    from checks import queries

    rows = spark.range(4000).selectExpr("IF(id < 3900, 'x', 'y') AS page", "id AS doc_id", "repeat('a', 100) AS text")
    monkeypatch.setattr(queries, "_CODED_BYTES", 10_000)
    assert queries._coded_files(rows) == {"x": 39, "y": 2}
