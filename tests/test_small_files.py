"""Many small files: their samples share tasks, and each has a verdict of its own."""

from sluice.sources import gates


def test_samples_of_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / "in" / f"file={i}"
        folder.mkdir(parents=True)
        # what is wrong behind the first bytes isn't seen, nor is it taken for the next file's
        text = {7: b"a,\0b\n", 8: b"a\n" * 9000 + b"\0\n", 9: b"a,\xff\n", 10: b"x" * 8191 + "é".encode() + b"\n1\n", 11: b"a\n" * 800_000 + b"\0", 12: b"\0a\n" + b"1\n" * 800_000}.get(i, f"a,b\n{i},2\n".encode())
        (folder / "part.csv").write_bytes(text)
    found = gates.sample_verdicts(spark, f"file://{tmp_path}/in", sample_bytes=8192)
    got = {r["path"].split("file=")[1].split("/")[0]: (r["has_nul"], r["bad_utf8"]) for r in found.collect()}
    assert got == {str(i): (i in (7, 12), i == 9) for i in range(60)} and found.count() == 60
    assert len(found.inputFiles()) < 30
