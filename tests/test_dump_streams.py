import bz2

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import dump


def _page(i):
    text = f"text {i} &lt;b&gt; é" + " words of the page" * (20_000 if i == 7 else i)
    return (
        f"  <page>\n    <title>A:{i} &amp; b</title>\n    <id>{i}</id>\n    <revision><id>{i + 900}</id>"
        f"<timestamp>2025-01-02T03:04:05Z</timestamp>\n      <text xml:space=\"preserve\">{text}</text></revision>\n  </page>\n"
    )


def _write(folder, name, ids, per_stream=3):
    """A multistream dump and its index; the paths, and the bytes of the streams that hold pages."""
    head, tail = "<mediawiki>\n<siteinfo></siteinfo>\n", "</mediawiki>\n"
    whole, lines, sizes = bz2.compress(head.encode()), [], {}
    for at in range(0, len(ids), per_stream):
        some = ids[at : at + per_stream]
        stream = bz2.compress("".join(map(_page, some)).encode())
        lines += [f"{len(whole)}:{i}:A:{i} &amp; b" for i in some]
        sizes |= {i: (len(whole), len(stream)) for i in some}
        whole += stream
    whole += bz2.compress(tail.encode())
    path, index = folder / f"{name}.xml.bz2", folder / f"{name}-index.txt.bz2"
    path.write_bytes(whole)
    index.write_bytes(bz2.compress("".join(f"{x}\n" for x in lines).encode()))
    return str(path), str(index), sizes


@pytest.fixture
def files(tmp_path):
    return _write(tmp_path, "one", list(range(20))), _write(tmp_path, "two", list(range(20, 31)))


def test_streams_give_the_pages_of_the_whole_dump(spark, files):
    paths, indexes = [f[0] for f in files], [f[1] for f in files]
    plain = sorted(map(tuple, dump.read_dump_pages(spark, paths).collect()))
    assert len(plain) == 31 and plain[7][1] == "A:7 & b"
    assert sorted(map(tuple, dump.read_dump_pages(spark, paths, indexes).collect())) == plain
    assert sorted(map(tuple, dump.read_dump_pages(spark, paths[0], indexes[0]).collect())) == plain[:20]


def test_only_streams_of_wanted_pages_are_read(spark, files):
    paths, indexes = [f[0] for f in files], [f[1] for f in files]
    sizes = files[0][2] | {i: (s[0] + (1 << 40), s[1]) for i, s in files[1][2].items()}
    for wanted, ids in (
        (F.col("title").isin("A:4 & b", "A:25 & b", "no page"), [4, 25]),
        (F.col("page_id") == 7, [7]),
        (spark.createDataFrame([("A:4 & b", 1), ("A:5 & b", 2), ("A:4 & b", 1)], "title string, note int"), [4, 5]),
        (spark.createDataFrame([(30,)], "page_id long"), [30]),
        (F.lit(False), []),
    ):
        got = dump.read_dump_pages(spark, paths, indexes, wanted)
        assert sorted(r.page_id for r in got.collect()) == ids
        entries = dump._wanted(dump._index_entries(spark, paths, indexes), wanted)
        read = dump.read_streams(entries).agg(F.sum("n_bytes").alias("n")).first()["n"]
        assert (read or 0) == sum(size for _, size in {sizes[i] for i in ids})


def test_wrong_indexes_fail(spark, files, tmp_path):
    (path, index, _), other = files
    with pytest.raises(ValueError, match="its own index"):
        dump.read_dump_pages(spark, [path, other[0]], index)
    with pytest.raises(ValueError, match="through an index"):
        dump.read_dump_pages(spark, path, wanted=F.lit(True))
    cut = tmp_path / "cut.xml.bz2"
    cut.write_bytes(open(path, "rb").read()[:-200])
    with pytest.raises(Exception, match="breaks off"):
        dump.read_dump_pages(spark, str(cut), index).count()
