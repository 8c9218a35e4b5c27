"""Scratch tables: owned by the calling thread, released by their result, gone when the application ends."""

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier

from plumbline.llm import common, registry

DATA = "/root/testdata/sf0.001"


def folders(spark):
    top = Path(common.shared_dir(spark).removeprefix("file://")) / "plumbline" / spark.sparkContext.applicationId
    return {p.name for p in top.iterdir()} if top.exists() else set()


def test_threads_own_their_tables(spark):
    """Each of two threads makes a table before the other drops its own; neither loses what it keeps."""
    met = Barrier(2)

    def run(i):
        mark = common.mark()
        gone, kept = (common.stored(spark.range(3 + i).toDF("x"), label) for label in ("gone", "kept"))
        met.wait(60)
        common.drop_since(spark, mark, kept)
        met.wait(60)
        assert kept.count() == 3 + i
        return kept, gone.inputFiles()

    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(run, range(2)))
    assert not [f for _, files in done for f in files if os.path.exists(f.removeprefix("file://"))]
    before = folders(spark)
    for kept, _ in done:
        common.release(kept)
    assert len(before) - len(folders(spark)) == 2
    assert spark.conf.get(common._CLEANUP, "false") == "false"  # as it was


def test_operators_side_by_side(spark):
    """Pairs of operators that once removed each other's tables; nothing is left once their results are released."""
    before, known = folders(spark), registry.queries()
    for pair in (("op8_log_templates", "op9_exact_topk"), ("op7_surrogates", "op4_permutation_index"), ("op13_whitening", "op6_packing")):
        with ThreadPoolExecutor(2) as pool:
            results = list(pool.map(lambda name: known[name](spark, DATA), pair))
            counts = list(pool.map(lambda df: df.count(), results))
        assert all(counts)
        for df in results:
            common.release(df)
    assert folders(spark) <= before


def test_nothing_is_left_when_the_application_ends(tmp_path):
    code = f"""
from plumbline.session import session
from plumbline.llm import common
spark = session("end", "local[1]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}"}})
df = common.stored(spark.range(5), "left")
assert df.count() == 5
print(df.inputFiles()[0])
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ, check=False)
    assert ran.returncode == 0, ran.stderr[-2000:]
    path = ran.stdout.strip().splitlines()[-1].removeprefix("file://")
    assert str(tmp_path) in path and not os.path.exists(path)
