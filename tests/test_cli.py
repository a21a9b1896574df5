"""The command line runs a registered query end to end."""

import subprocess
import sys

from tests.conftest import ROOT, SF001


def test_cli_list():
    out = subprocess.run([sys.executable, "-m", "quillrank", "list"], cwd=ROOT, capture_output=True, text=True,
                         timeout=120)
    assert out.returncode == 0 and "feature_means" in out.stdout and "oracle" in out.stdout


def test_cli_run_writes_result(tmp_path):
    dest = tmp_path / "means"
    out = subprocess.run([sys.executable, "-m", "quillrank", "run", "feature_means", "--data", SF001,
                          "--master", "local[2]", "--out", str(dest), "--format", "json"],
                         cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [l for f in dest.glob("part-*") for l in f.read_text().splitlines() if l.strip()]
    assert len(lines) == 6
