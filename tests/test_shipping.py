import os
import subprocess
import sys

from pyspark import cloudpickle

from supportgraph.operators.blocks import TopK, unit_rows

LOAD = "import pyspark, pickle, sys; print(pickle.loads(sys.stdin.buffer.read())[0].__name__)"


def test_task_code_needs_no_package_on_the_executor(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", LOAD],
        input=cloudpickle.dumps((TopK, unit_rows)),
        capture_output=True,
        cwd=tmp_path,
        env=env,
        timeout=120,
    )
    assert done.stdout.decode().strip() == "TopK", done.stderr.decode()
