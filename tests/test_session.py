"""The checkpoint folder comes from the session; a scratch one only when unset."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from shopflow.session import build_session, ensure_checkpoint_dir
conf = {{"spark.checkpoint.dir": {ckpt!r}}} if {ckpt!r} else {{}}
spark = build_session("local[1]", conf=conf)
print("CKPT", ensure_checkpoint_dir(spark))
print("PARTS", spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "unset"))
spark.stop()
"""


def run(ckpt, conf_dir=None):
    env = dict(os.environ)
    if conf_dir is not None:
        env["SPARK_CONF_DIR"] = conf_dir  # which spark-defaults.conf applies
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, ckpt=ckpt)],
                         capture_output=True, text=True, timeout=300, env=env)
    lines = dict(x.split(" ", 1) for x in out.stdout.splitlines() if x.startswith(("CKPT", "PARTS")))
    return lines


def test_checkpoint_dir_from_session():
    shared = tempfile.mkdtemp(prefix="shared-ckpt-")
    got = run(shared)
    assert got["CKPT"].removeprefix("file:").startswith(shared)
    assert got["PARTS"] == "200"  # 3 per core, at least 200


def test_checkpoint_dir_from_cluster_defaults():
    conf_dir = tempfile.mkdtemp(prefix="conf-")
    shared = tempfile.mkdtemp(prefix="cluster-ckpt-")
    with open(os.path.join(conf_dir, "spark-defaults.conf"), "w") as f:
        f.write(f"spark.checkpoint.dir {shared}\n")
    assert shared in run("", conf_dir)["CKPT"]


def test_scratch_checkpoint_only_when_unset():
    got = run("", tempfile.mkdtemp(prefix="empty-conf-"))
    assert "shopflow-ckpt-" in got["CKPT"]


def test_shuffle_sizing_counts_configured_executors():
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from shopflow.session import build_session
spark = build_session("local[1]", conf={{"spark.executor.instances": "100", "spark.executor.cores": "8"}})
print("PARTS", spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "PARTS 2400" in out.stdout
