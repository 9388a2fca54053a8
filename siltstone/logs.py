"""Log routing: everything to a file, the gist to the console, a child's output line by line; secrets are masked."""

from __future__ import annotations

import logging
import os
import re
import subprocess
import threading

from siltstone.sources.files import SERVICE_KEYS

FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


class Masked(logging.Filter):
    """Replaces the values of the services' keys, as the environment has them now."""

    def filter(self, record: logging.LogRecord) -> bool:
        values = [re.escape(v) for k in SERVICE_KEYS.values() if (v := os.environ.get(k))]
        if values:
            record.msg, record.args = re.sub("|".join(values), "***", record.getMessage()), ()
        return True


def routed(path: str, name: str = "siltstone") -> logging.Logger:
    """A logger with a file handler at DEBUG and a console handler at INFO; a second call replaces both."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for handler, level in ((logging.FileHandler(path, encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(), logging.INFO)):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter(FORMAT))
        handler.addFilter(Masked())
        logger.addHandler(handler)
    return logger


def relayed(command: list[str], logger: logging.Logger, **options) -> int:
    """Runs a command; its output goes to the log at INFO, its errors at WARNING, line by line. Returns its exit code."""
    child = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", **options)

    def read(stream, level: int) -> None:
        for line in stream:
            logger.log(level, "%s", line.rstrip("\n"))

    readers = [threading.Thread(target=read, args=x) for x in ((child.stdout, logging.INFO), (child.stderr, logging.WARNING))]
    for r in readers:
        r.start()
    for r in readers:
        r.join()
    return child.wait()
