"""Scripts in child processes of an interpreter that has already started: a fork for each in place of a start of Python."""

from __future__ import annotations

import contextlib
import os
import socket
import subprocess
import sys
import tempfile
import time

OUTPUT = 1 << 20
# Fixed values.
TIMED_OUT = "Execution timed out after"
# End of fixed values.
LOST = "Execution ended the interpreter that ran it"

#: The interpreter that waits. It has one thread, so that a fork is safe, and imports what the harness of each script imports.
#: It asks for nothing but a line for each script: timeout, bytes of memory (0: no limit), folder; and answers 1 if the time
#: was over, and the exit status. The child is a session of its own in that folder, whose `out` and `err` are there already, and
#: goes on below the definitions with its script as the main module. At its end threads, exit functions, the script's own
#: objects and the streams are seen to as at any end; what the waiting interpreter held is not torn down (13 of 18 ms).
SERVER = """
import atexit, gc, importlib.machinery, inspect, os, resource, signal, sys, time, types

def serve(control):
    signal.pthread_sigmask(signal.SIG_BLOCK, [signal.SIGCHLD])
    os.write(control, b"ready\\n")
    while True:
        asked = b""
        while not asked.endswith(b"\\n"):
            more = os.read(control, 65536)
            if not more:
                os._exit(0)
            asked += more
        timeout, memory, folder = asked[:-1].split(b" ", 2)
        child = os.fork()
        if not child:
            return int(memory), os.fsdecode(folder)
        end, late = time.monotonic() + float(timeout), 0
        while not os.waitid(os.P_PID, child, os.WEXITED | os.WNOWAIT | os.WNOHANG):
            left = end - time.monotonic()
            if left <= 0:
                late = 1
                break
            signal.sigtimedwait([signal.SIGCHLD], left)
        for kill in (os.killpg, os.kill):
            try:
                kill(child, signal.SIGKILL)
            except ProcessLookupError:
                pass
        os.write(control, b"%d %d\\n" % (late, os.waitpid(child, 0)[1]))

def become(folder, memory, control):
    os.setsid()
    os.chdir(folder)
    for fd, name, how in ((0, os.devnull, os.O_RDONLY), (1, "out", os.O_RDWR), (2, "err", os.O_RDWR)):
        opened = os.open(name, how)
        os.dup2(opened, fd)
        os.close(opened)
    os.close(control)
    signal.pthread_sigmask(signal.SIG_UNBLOCK, [signal.SIGCHLD])
    if memory:
        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
    path = os.path.join(folder, "run.py")
    main = types.ModuleType("__main__")
    main.__file__, main.__cached__, main.__loader__ = path, None, importlib.machinery.SourceFileLoader("__main__", path)
    sys.modules["__main__"], sys.argv, sys.orig_argv = main, [path], [sys.executable, "-I", path]
    return main

def ended(e):
    # The exit status, and what an interpreter says of the exception that ended its script
    if not isinstance(e, SystemExit):
        sys.excepthook(type(e), e.with_traceback(e.__traceback__.tb_next), e.__traceback__)
        return 1
    if e.code is None or isinstance(e.code, int):
        return (e.code or 0) & 255
    print(e.code, file=sys.stderr)
    return 1

def finish(main, status):
    if "threading" in sys.modules:
        sys.modules["threading"]._shutdown()
    atexit._run_exitfuncs()
    for last in (False, True):
        for stream in (sys.stdout, sys.stderr):
            try:
                if stream is not None and not stream.closed:
                    stream.flush()
            except Exception:
                status = 120
        if not last:
            main.__dict__.clear()
            gc.collect()
    os._exit(status)

control, status = int(sys.argv[1]), 0
gc.collect()
gc.freeze()
memory, folder = serve(control)
main = become(folder, memory, control)
try:
    with open(main.__file__, "rb") as source:
        text = source.read()
    exec(compile(text, main.__file__, "exec", dont_inherit=True), main.__dict__)
except BaseException as e:
    status = ended(e)
finish(main, status)
"""


class Interpreter:
    """Runs one script at a time. It starts when it is first used and ends with the `with` block, or when its process does."""

    def __init__(self):
        self.process: subprocess.Popen | None = None

    def __enter__(self) -> Interpreter:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def start(self) -> None:
        ours, theirs = socket.socketpair()
        # regular files, as the scripts' own are; a script never sees these
        with theirs, tempfile.TemporaryFile() as said:
            command = [sys.executable, "-I", "-c", SERVER, str(theirs.fileno())]
            self.process = subprocess.Popen(command, cwd="/", env={}, stdin=subprocess.DEVNULL, stdout=said, stderr=said, pass_fds=[theirs.fileno()], start_new_session=True)
            theirs.close()
            self.control = ours
            if self.answer() != b"ready":
                self.stop()
                said.seek(0)
                raise RuntimeError(f"the interpreter for scripts did not start: {said.read(OUTPUT).decode('utf-8', 'replace')}")

    def stop(self) -> None:
        if self.process:
            self.control.close()
            self.process.kill()
            self.process.wait()
            self.process = None

    def answer(self) -> bytes | None:
        """A line without its end; None if the interpreter is gone."""
        line = b""
        while not line.endswith(b"\n"):
            try:
                more = self.control.recv(4096)
            except ConnectionError:
                return None
            if not more:
                return None
            line += more
        return line[:-1]

    def ask(self, line: bytes) -> bytes | None:
        if not self.process:
            self.start()
        with contextlib.suppress(ConnectionError):
            self.control.sendall(line)
        said = self.answer()
        if said is None:
            self.stop()
        return said

    def execute(self, script: str, timeout: float, memory_mb: int | None = None) -> tuple[bool, str, float]:
        """Whether a script ends well, its output (errors if not; OUTPUT bytes at most), and the seconds it took. Its own folder,
        no environment, killed with its children after the timeout. A script whose interpreter goes meanwhile is run once more."""
        with tempfile.TemporaryDirectory() as folder:
            with open(os.path.join(folder, "run.py"), "w", encoding="utf-8", errors="replace") as f:
                f.write(script)
            asked = b"%r %d %s\n" % (float(timeout), (memory_mb or 0) << 20, os.fsencode(folder))
            if not self.process:
                self.start()
            for _ in range(2):
                began = time.time()
                with open(os.path.join(folder, "out"), "w+b") as out, open(os.path.join(folder, "err"), "w+b") as err:
                    said = self.ask(asked)
                    took = time.time() - began
                    if said is None:
                        continue
                    late, status = map(int, said.split())
                    if late:
                        return False, f"{TIMED_OUT} {timeout:g} seconds", took
                    told = err if status else out
                    told.seek(0)
                    return status == 0, told.read(OUTPUT).decode("utf-8", "replace"), took
            return False, LOST, took
