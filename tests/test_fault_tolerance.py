import os
import subprocess
import sys

from conftest import ROOT


def test_salted_join_survives_a_failed_task_attempt(scratch):
    marker = os.path.join(scratch, "failures")
    env = dict(os.environ, PYTHONPATH=ROOT)
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tests", "jobs", "retry_job.py"), ROOT,
                          marker],
                         capture_output=True, text=True, timeout=600, env=env)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    assert line[0].split()[1] == "True"
    with open(marker) as fh:  # the failure really happened and was retried
        assert fh.read().count("failed once") >= 1
