"""What travels to the workers: small closures, and no need of an installed package."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from procsight.llm import decontaminate, memory, simhash, toxicity, words
from tests.conftest import SF

ROOT = Path(__file__).resolve().parents[2]


def test_closures_stay_small_after_work_on_the_driver():
    text = pa.array([b"one two three " * 1000])
    data, at = words.raw(text)
    words.hashes(data, *words.spans(data, at)[:2])
    for f in (decontaminate._search(None), decontaminate._hash_rows, words.hashes, simhash.fingerprint, toxicity.score):
        assert len(cloudpickle.dumps(f)) < 200_000


def test_only_the_latest_is_remembered():
    assert memory.once("test", 1, lambda: "a") == memory.once("test", 1, lambda: "b") == "a"
    assert memory.once("test", 2, lambda: "c") == "c" and list(memory.remembered("latest")) == [("test", 2)]


def test_powers_are_kept_between_calls():
    data = np.frombuffer(b"word other word", np.uint8)
    h = words.hashes(data, np.array([0, 5, 11]), np.array([4, 10, 15]))
    assert h[0] == h[2] != h[1] and len(memory.remembered("powers")["up"]) >= words.BLOCK


def test_workers_need_no_installed_package(tmp_path):
    """The driver finds the package by its own path; workers start in a folder without it."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from procsight.llm.queries import op9_decontamination, op10_language_id
print(op9_decontamination(spark, {SF!r}).count(), op10_language_id(spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]
