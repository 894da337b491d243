"""Documents of many agents: as those in folders, in files whose number doesn't follow the agents."""

import os
from pathlib import Path

from lectern.plans import writes
from lectern.streaming import trajectories

LINE = "agent string, seq long, line string"


def test_documents_are_those_of_the_folders(spark, tmp_path):
    lines = [(a, i, f'[x] "{i}" ä' if i % 3 else "") for a in ("a", "b/c", "d") for i in range(1, 15)]
    rows = trajectories.events(spark.createDataFrame(lines, LINE))
    trajectories.write_trajectories(rows, str(tmp_path / "folders"))
    trajectories.write_documents(rows, str(tmp_path / "table"))
    table = sorted(spark.read.parquet(str(tmp_path / "table")).collect(), key=lambda r: (r["file"], r["place"]))
    for name, folder in (("a", "a"), ("b/c", "b%2Fc"), ("d", "d")):
        (part,) = (tmp_path / "folders" / f"file={folder}").glob("part-*")
        assert part.read_text() == "".join(r["line"] + "\n" for r in table if r["file"] == name)


def test_files_do_not_follow_conversations(spark, tmp_path, monkeypatch):
    """The query's files: no more for 300 conversations than tasks write."""
    data, root = str(tmp_path / "data"), str(tmp_path / "out")
    os.makedirs(data)
    spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c}") for c in range(300) for t in range(3)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{data}/conversations.parquet")
    folders = iter([f"{root}/{i}" for i in range(9)])
    monkeypatch.setattr(writes, "shared_folder", lambda spark: next(folders))
    got = writes.trajectory_files(spark, data)
    assert got.select("conv_id").distinct().count() == 300
    written = [f for f in Path(root).rglob("part-*")]
    assert 0 < len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
