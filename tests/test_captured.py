"""Archives, paged responses and written runs read as what they hold."""

import gzip
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from undertow.sources import artifacts, captured

TREE = {"src/a.ts": "let a = 'é'", "app/b.tsx": "b", "node_modules/x.ts": "x", ".git/y.ts": "y", "c.css": "c", "src/big.ts": "y" * 3000, "d.js": "", "app/deep/er/e.mjs": "e"}


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "archives"
    folder.mkdir()
    for name, mode in (("one.tar.gz", "w:gz"), ("two.tgz", "w:gz"), ("three.tar", "w")):
        with tarfile.open(folder / name, mode) as out:
            for path, text in TREE.items():
                data = text.encode()
                m = tarfile.TarInfo(f"owner-repo-{name}/{path}")
                m.size = len(data)
                out.addfile(m, io.BytesIO(data))
            out.addfile(tarfile.TarInfo("owner-repo/dir.ts/"))
            link = tarfile.TarInfo("owner-repo/link.ts")
            link.type, link.linkname = tarfile.SYMTYPE, "src/a.ts"
            out.addfile(link)
    (folder / "notes.txt").write_text("no archive")
    return str(folder)


def test_archives_equal_the_unpacked_tree(spark, archives, tmp_path):
    captured.register(spark)
    for path, text in TREE.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    want = {tuple(r) for r in artifacts.source_tree(spark, str(tmp_path / "tree"), 2000).collect()}
    rows = spark.read.format("source_archive").option("most_bytes", 2000).load(archives).collect()
    for name in ("one.tar.gz", "two.tgz", "three.tar"):
        assert {(r.path, r.source) for r in rows if r.archive == name} == want | {("d.js", "")}
    assert len(rows) == 3 * len(want) + 3
    one = spark.read.format("source_archive").option("prefix", "app/").load(f"{archives}/one.tar.gz").collect()
    assert {r.path for r in one} == {"app/b.tsx", "app/deep/er/e.mjs"}


def test_options_drop_files_before_they_are_opened(spark, archives, tmp_path):
    captured.register(spark)
    with open(f"{archives}/bad.tar.gz", "wb") as out:  # reading it fails
        out.write(gzip.compress(b"no tar at all" * 100))
    df = spark.read.format("source_archive").option("archive", "two.tgz,one.tar.gz").load(archives)
    assert df.where("archive = 'two.tgz' AND path = 'src/big.ts'").select("source").first().source == "y" * 3000 and df.count() == 10
    with pytest.raises(Exception, match="ReadError"):
        spark.read.format("source_archive").load(archives).count()


def test_paged_responses(spark, tmp_path):
    captured.register(spark)
    for number, page, n in ((7, 1, 100), (7, 2, 3), (8, 1, 2)):
        (tmp_path / f"pr-{number}-page-{page}.json").write_text(json.dumps([{"filename": f"f{number}-{page}-{i}.ts", "status": "added", "additions": i} for i in range(n)]))
    (tmp_path / "pr-9-page-1.json").write_text("broken")
    (tmp_path / "other.json").write_text("broken")
    read = lambda **o: spark.read.format("paged_responses").options(**o).load(str(tmp_path))
    rows = read(number="7").select("page", "at", F.from_json("item", artifacts.PULL_FILE).alias("f")).collect()
    assert len(rows) == 103 and {r.f.filename for r in rows if r.page == 2} == {"f7-2-0.ts", "f7-2-1.ts", "f7-2-2.ts"}
    assert read(number="7,8").count() == 105 and read(number="7", page="2").count() == 3 and read(number="1").count() == 0
    with pytest.raises(Exception, match="JSON"):
        read().count()


def test_a_written_run_is_read_again(spark, tmp_path):
    n = 25_000
    screens = spark.range(n).select(F.col("id").cast("int").alias("seq"), F.concat(F.lit("s"), "id").alias("screenId"), F.concat(F.lit("https://x.test/"), "id").alias("url"), F.lit('q"\n').alias("title"), F.array(F.lit("a")).alias("primaryActions"))
    moves = spark.createDataFrame([(0, "a", "b"), (1, "b", None), (2, "a", "b")], "seq int, fromUrl string, toUrl string")
    symbol = "array<struct<name:string,kind:string,filePath:string,line:int,exported:boolean>>"
    files = spark.range(3).select(F.col("id").cast("int").alias("seq"), F.concat(F.lit("f"), "id").alias("path"), F.from_json(F.lit('[{"name":"x","kind":"function","filePath":"f","line":1,"exported":true}]'), symbol).alias("symbols"))
    run = {"screens": screens.repartition(7), "transitions": moves, "requirements": spark.createDataFrame([(0, "R1", "t")], "seq int, reqId string, title string"), "files": files, "imports": spark.createDataFrame([], "seq int, fromFile string, toFile string, importedName string")}
    artifacts.save_run(run, str(tmp_path / "run"), heads={"code.json": {"fullName": "o/r", "ref": "main"}}, rows=1000)
    got = artifacts.load_run(spark, str(tmp_path / "run"))
    for name, df in run.items():
        a, b = got[name].select(df.columns), df
        assert a.count() == df.count() and not a.exceptAll(b).count(), name
    assert got["symbols"].count() == 3 and not got["calls"].count()
    lines = [json.loads(x) for f in os.listdir(tmp_path / "run/code.json") if f.startswith("part-") for x in open(tmp_path / "run/code.json" / f)]
    assert {"fullName": "o/r", "ref": "main"} in lines
    assert max(len(json.loads(x).get("screens", [])) for f in os.listdir(tmp_path / "run/crawl/manifest.json") if f.startswith("part-") for x in open(tmp_path / "run/crawl/manifest.json" / f)) == 1000
