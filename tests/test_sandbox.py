"""Scripts in forks of a waiting interpreter end as in an interpreter of their own, in a small part of its time."""

import subprocess
import sys
import time

import pytest

from siltstone.operators import sandbox

SCRIPTS = [
    "print(1)", "1/0", "def f(:", "import sys; sys.exit('bye')", "import sys; sys.exit(3)", "raise SystemExit", "import sys; sys.exit(256)",
    "import __main__; print(__name__, __spec__, __file__[-6:], __main__.__dict__ is globals())", "import atexit; atexit.register(print, 'end'); print('x')",
    "import threading, time\nthreading.Thread(target=lambda: (time.sleep(0.1), print('late'))).start()", "class A:\n    def __del__(self): print('gone')\na = A()\na.b = a",
    "import os; os.remove('out'); print('still')", "import os, sys; print(dict(os.environ), os.getcwd()[:4], sys.path, sys.argv[0][-6:], sys.flags, sys.stdin.read())",
    "import sys; print(sys.stdout.seekable(), sys.stdout.encoding, sys.stderr.encoding)", "def f(n): return g(n)\ndef g(n): raise ValueError(n)\nf(2)", "import os; os._exit(7)",
    "import os; os.abort()", "from inspect import signature; print(signature(lambda a, b: 0))", "import os\nif os.fork() == 0:\n    import time; time.sleep(30)\nprint('parent')",
    "try:\n    1/0\nexcept Exception as e:\n    raise KeyError('k') from e", "import sys\nsys.excepthook = lambda t, v, tb: print('hook', t.__name__, tb.tb_lineno, file=sys.stderr)\n\nint('x')",
]


@pytest.fixture(scope="module")
def interpreter():
    with sandbox.Interpreter() as it:
        yield it


@pytest.mark.parametrize("script", SCRIPTS)
def test_as_in_an_interpreter_of_its_own(interpreter, tmp_path, script):
    path = tmp_path / "run.py"
    path.write_text(script)
    with open(tmp_path / "out", "w+b") as out, open(tmp_path / "err", "w+b") as err:
        code = subprocess.Popen([sys.executable, "-I", str(path)], cwd=tmp_path, env={}, stdin=subprocess.DEVNULL, stdout=out, stderr=err).wait()
        (err if code else out).seek(0)
        want = (err if code else out).read().decode().replace(str(tmp_path), "")
    ok, said, _ = interpreter.execute(script, 20.0)
    folder = said.partition('File "')[2].partition("/run.py")[0]
    assert (ok, said.replace(folder, "") if folder else said) == (code == 0, want)


def test_scripts_do_not_see_each_other(interpreter):
    assert interpreter.execute("import os, builtins; builtins.x = 1; os.x = 1; open('f', 'w').close(); os.chdir('/')", 20.0)[0]
    assert interpreter.execute("import os, builtins; print(hasattr(builtins, 'x'), hasattr(os, 'x'), sorted(os.listdir()))", 20.0)[:2] == (True, "False False ['err', 'out', 'run.py']\n")


def test_limits_hold_and_the_next_script_runs(interpreter):
    assert interpreter.execute("while True: pass", 0.5)[:2] == (False, "Execution timed out after 0.5 seconds")
    assert not interpreter.execute("x = 'a' * 10**9", 20.0, memory_mb=200)[0]
    assert interpreter.execute("import os, time; os.kill(os.getppid(), 9); time.sleep(5)", 20.0)[:2] == (False, sandbox.LOST)
    assert interpreter.execute("print(2)", 20.0)[:2] == (True, "2\n")


def test_no_start_of_python_for_each_script(interpreter):
    began = time.time()
    for _ in range(10):
        subprocess.run([sys.executable, "-I", "-c", "from inspect import signature"], env={}, check=True)
    started = time.time() - began
    began = time.time()
    assert all(interpreter.execute("from inspect import signature", 20.0)[0] for _ in range(10))
    assert time.time() - began < started / 2


def test_an_interpreter_that_does_not_start_raises(monkeypatch):
    monkeypatch.setattr(sandbox, "SERVER", "raise ValueError('no')")
    with sandbox.Interpreter() as it, pytest.raises(RuntimeError, match="no"):
        it.execute("print(1)", 5.0)


def test_rows_are_validated_by_forks(spark):
    """a script's parent is the waiting interpreter, which leads a session, and not the worker that Spark started."""
    from siltstone.operators import validate

    rows = spark.createDataFrame([(i, "import math, os\nprint(os.getsid(os.getppid()) == os.getppid())") for i in range(6)], "id int, response string")
    assert [r["execution_output"] for r in validate.validated(rows).collect()] == ["True\n"] * 6
