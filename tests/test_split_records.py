"""Files cut into records by many tasks, against the CSV reader that sees them whole."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import delimited, split_records
from plumbline.sources.catalogue import scan_catalogue
from plumbline.sources.code_pages import DOUBLE_BYTE, SINGLE_BYTE, code_page

SECTORS = [("All", "all", "ALL")]


def whole(spark, files, delimiter=",", width=3):
    """Cells of every file by the CSV reader, one task a file."""
    paths = [r.file_path for r in files.collect()]
    read = delimited._read_group(spark, paths, "utf-8", delimiter, width).where("keep")
    rows = {}
    for r in read.orderBy("source", "place").collect():
        rows.setdefault(r.source, []).append(r.cells)
    return rows


def split(spark, files, run_bytes):
    sniffed = delimited.sniff_files(spark, files)
    cells = delimited.read_cells(spark, sniffed, run_bytes)
    rows = {}
    named = cells.join(sniffed.select("dataset_id", "source"), "dataset_id")
    for r in named.orderBy("source", "row_id").collect():
        rows.setdefault(r.source, []).append(r.cells)
    return rows


def quoted(rng, end):
    """A file of proper records with line ends, delimiters and quotes inside quotes."""
    def cell():
        kind = rng.randrange(6)
        text = "".join(rng.choice(["a", "bc", "é", " ", "7", "x"]) for _ in range(rng.randrange(6)))
        if kind < 3:
            return text
        inner = "".join(rng.choice(["a", ",", '""', "\n", "\r\n" if end == "\r\n" else "\n", "é", "  "]) for _ in range(rng.randrange(30)))
        return f'"{inner}"'

    lines = ["one,two,three"] + [",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rng.randrange(1, 40))]
    text = end.join(lines)
    return text + rng.choice(["", end, end + end])


def noise(rng):
    """Anything at all after a header, quotes in odd places too."""
    marks = ["a", "b", ",", ",", '"', '"', "\n", "\n", " ", '""', '","', '"\n']
    return "h,i,j\n" + "".join(rng.choice(marks) for _ in range(rng.randrange(1, 300)))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("split")
    (root / "all").mkdir()
    rng = random.Random(11)
    for i in range(8):
        (root / "all" / f"lf{i:02d}.csv").write_bytes(quoted(rng, "\n").encode())
        (root / "all" / f"wide{i:02d}.csv").write_bytes(quoted(rng, "\r\n").encode())
        (root / "all" / f"noise{i:02d}.csv").write_bytes(noise(rng).encode())
    (root / "all" / "mixed.csv").write_bytes(b'a,b,c\n1,2,3\r\n4,"x\r\ny",6\n"7\n",8,9\r\n')
    (root / "all" / "wide mixed.csv").write_bytes(b'a,b,c\r\n1,2,3\n4,"x\r\ny\nz",6\r\n7,8,9')
    long = '1,"' + "many\nlines, " * 400 + '",3\n'
    (root / "all" / "long.csv").write_text("a,b,c\n" + "1,2,3\n" * 50 + long + "4,5,6\n" * 50)
    return scan_catalogue(spark, str(root), SECTORS).cache()


@pytest.mark.parametrize("run_bytes", [60, 1 << 20])
def test_equal_to_the_reader_of_whole_files(spark, written, run_bytes):
    want, got = whole(spark, written), split(spark, written, run_bytes)
    names = {r.source: r.file_name for r in written.collect()}
    for s in names:
        if names[s].startswith("noise"):  # a stray quote at a record's end
            for rows in (want[s], got[s]):
                rows[:] = [[None if x is None else x.rstrip('"') for x in r] for r in rows]
    wrong = {names[s] for s in names if want.get(s) != got.get(s)}
    # The reader of whole files takes a lone line feed there for text.
    assert wrong <= {"wide mixed.csv"}
    mixed = next(s for s in names if names[s] == "wide mixed.csv")
    assert got[mixed] == [["1", "2", "3"], ["4", "x\ny\nz", "6"], ["7", "8", "9"]]


def test_runs_that_meet_their_lines_by_a_shuffle(spark, written):
    sniffed = delimited.sniff_files(spark, written).where("load_ok").select(
        "source", "delimiter", (F.col("line_end") == "\r\n").alias("wide_end")
    )
    folder = written.first().file_path.rsplit("/", 1)[0]
    with delimited._run_bytes(spark, 200):
        one, two = (
            split_records.split_records(spark, [folder], sniffed, most).collect() for most in (1 << 20, 0)
        )
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) > 200


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "all").mkdir()
    rows = [f'{i},"line {i}\nsecond, ""quoted"" line",{i % 7}\n' for i in range(60_000)]
    (tmp_path / "all" / "large.csv").write_text("n,text,m\n" + "".join(rows))
    files = scan_catalogue(spark, str(tmp_path), SECTORS)
    sniffed = delimited.sniff_files(spark, files)
    with delimited._run_bytes(spark, 100_000):
        lines = split_records._lines(spark, [str(tmp_path / "all")])
        assert lines.rdd.getNumPartitions() > 20
    cells = delimited.read_cells(spark, sniffed, 100_000)
    n, total, least, most, ids = cells.agg(
        F.count("*"), F.sum(F.col("cells")[0].cast("long")), F.min("row_id"), F.max("row_id"), F.countDistinct("row_id")
    ).first()
    assert (n, total, least, most, ids) == (60_000, 60_000 * 59_999 // 2, 0, 59_999, 60_000)
    assert cells.where(F.col("cells")[0].cast("long") != F.col("row_id")).isEmpty()
    assert cells.select(F.col("cells")[1]).where("row_id = 41").first()[0] == 'line 41\nsecond, "quoted" line'


def test_short_runs_share_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "all").mkdir()
    rows = [f'{i},"line {i}\nsecond, ""quoted"" line"\n' for i in range(5_000)]
    (tmp_path / "all" / "a.csv").write_text("n,text\n" + "".join(rows))
    sniffed = delimited.sniff_files(spark, scan_catalogue(spark, str(tmp_path), SECTORS))
    tasks, settle = {}, split_records.settle

    def counting(df, name):
        tasks[name] = df.rdd.getNumPartitions()
        return settle(df, name)

    monkeypatch.setattr(split_records, "settle", counting)
    cells = delimited.read_cells(spark, sniffed, 1_000)
    assert cells.select("row_id").distinct().count() == 5_000
    assert tasks["quote-transitions"] <= 16 and tasks["cut-records"] <= 16  # of 200 runs


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'"a', True, False), (b'"a","b', True, True), (b'a"b,c', False, False),
    (b'"a""', True, False), (b'"a"""', False, False), (b'x,"', True, False), (b'""', False, True), (b'"a"b,"c', True, True),
    (b'","', False, True),
])
def test_states_of_lines(line, outside, inside):
    assert split_records.ends_inside(line, False, ",") is outside
    assert split_records.ends_inside(line, True, ",") is inside


TEXTS = {
    "windows-1252": ["Die Größe der Stühle ist schön, aber Ärger über Öl", "El niño comió piñas mañana", "Les élèves français étaient déjà très gênés", "Smörgåsbord på ön"],
    "windows-1251": ["Привет, мир! Это обычный русский текст о погоде", "имя;город\nИван;Москва\nАнна;Казань"],
    "windows-1256": ["رقم,اسم\n1,نعم\n2,لا\n", "السلام عليكم ورحمة الله وبركاته"],
    "gb18030": ["中国的城市有很多人口", "姓名,城市\n张三,北京\n李四,上海"],
    "shift_jis": ["日本の都市には人がたくさんいます", "名前,都市\n田中,東京\n鈴木,大阪", "カタカナとひらがな"],
}


def test_code_pages_by_their_text():
    for page, texts in TEXTS.items():
        codec = {**SINGLE_BYTE, **DOUBLE_BYTE}[page]
        for text in texts:
            data = text.encode(codec)
            assert code_page(data) == page, text
            assert code_page(data * 4000) == page  # cut off at the bound, maybe inside a character
    assert code_page(b"plain,ascii") == code_page(b"\xe9;2") == "windows-1256"


def test_garbage_has_no_code_page():
    rng = random.Random(1)
    for n in (40, 400, 70_000):
        assert code_page(bytes(rng.randrange(256) for _ in range(n))) is None
        assert code_page(bytes(rng.randrange(128, 256) for _ in range(n))) is None


def test_files_of_every_code_page(spark, tmp_path):
    (tmp_path / "all").mkdir()
    for page, texts in TEXTS.items():
        codec = {**SINGLE_BYTE, **DOUBLE_BYTE}[page]
        body = "".join(f'{i},"{x}\n{x}"\n' for i, x in enumerate(texts))
        (tmp_path / "all" / f"{page}.csv").write_bytes(f"n,{texts[0][:3].replace(',', '')}\n{body}".encode(codec))
    (tmp_path / "all" / "zgarbage.csv").write_bytes(random.Random(2).randbytes(3000) + b"\n1,2\n")
    files = scan_catalogue(spark, str(tmp_path), SECTORS)
    for streamed_bytes in (1 << 30, 40):
        sniffed = delimited.sniff_files(spark, files, streamed_bytes)
        rows = {r.file_name: r for r in sniffed.collect()}
        garbage = rows.pop("zgarbage.csv")
        assert (garbage.load_ok, garbage.encoding) == (False, None) and "encoding" in garbage.error
        assert all(r.load_ok and name == f"{r.encoding}.csv" for name, r in rows.items())
    cells = delimited.read_cells(spark, sniffed, 50).join(sniffed.select("dataset_id", "encoding"), "dataset_id")
    got = {(r.encoding, int(r.cells[0])): r.cells[1] for r in cells.collect()}
    assert got == {(p, i): f"{x}\n{x}" for p, texts in TEXTS.items() for i, x in enumerate(texts)}
