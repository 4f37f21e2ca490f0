"""One writer per index: a lock file that names the writing process."""

from __future__ import annotations

import os
import socket
import time
import uuid
from pathlib import Path

NAME = "index.lock"
GRACE = 60  # seconds after which a lock that names nobody is a leftover


class LockTimeout(TimeoutError):
    pass


def link_or_copy(source: str | Path, target: str | Path) -> bool:
    """Makes `target` with what `source` holds, in one step. False where there is one already.

    Where the file system has no links the file is made empty, by one taker
    alone, and then filled.
    """
    try:
        os.link(source, target)
        return True
    except FileExistsError:
        return False
    except FileNotFoundError:
        raise
    except OSError:
        data = Path(source).read_bytes()
        try:
            handle = os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        return True


class LocalFiles:
    """The few things that a lock needs, in a folder of this machine."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def read_text(self, name: str) -> str | None:
        try:
            return (self.root / name).read_text()
        except FileNotFoundError:
            return None

    def age(self, name: str) -> float:
        try:
            return max(0.0, time.time() - (self.root / name).stat().st_mtime)
        except FileNotFoundError:
            return 0.0

    def create(self, name: str, text: str) -> bool:
        self.root.mkdir(parents=True, exist_ok=True)
        fresh = f"{name}.{uuid.uuid4().hex}"
        (self.root / fresh).write_text(text)
        return self.move(fresh, name)

    def move(self, name: str, to: str) -> bool:
        """Renames in one step. False, and `name` is gone, where `to` exists."""
        try:
            return link_or_copy(self.root / name, self.root / to)
        finally:
            self.delete(name)

    def delete(self, name: str) -> None:
        (self.root / name).unlink(missing_ok=True)


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class IndexLock:
    """Lock file beside the index, made in one step with the name of its holder.

    `folder` is a folder of this machine, or a store on any file system that
    creates without overwriting. A lock of a process of this machine that is
    gone, or that names nobody and is older than GRACE, is taken over. Taking
    over moves the lock away first; if that turns out to be the fresh lock of
    another taker it is put back, so two takers never remove each other's.
    """

    def __init__(self, folder, timeout: float = 30, poll: float = 1.0):
        self.files = LocalFiles(folder) if isinstance(folder, (str, Path)) else folder
        self.path = Path(str(self.files.root)) / NAME
        self.timeout, self.poll = timeout, poll
        self.mark = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
        self.held = False

    def _stale(self, text: str) -> bool:
        host, _, rest = text.strip().partition(" ")
        pid = rest.partition(" ")[0]
        if not pid.isdigit():
            return self.files.age(NAME) > GRACE
        return host == socket.gethostname() and not _alive(int(pid))

    def status(self) -> str:
        """``ours``, ``free`` or ``taken``; a leftover lock counts as free."""
        if self.held:
            return "ours"
        text = self.files.read_text(NAME)
        return "free" if text is None or self._stale(text) else "taken"

    def _remove_leftover(self) -> None:
        text = self.files.read_text(NAME)
        if text is None or not self._stale(text):
            return
        aside = f"{NAME}.{uuid.uuid4().hex}"
        try:
            moved = self.files.move(NAME, aside)
        except OSError:
            return
        if moved and self.files.read_text(aside) != text:
            self.files.move(aside, NAME)
        else:
            self.files.delete(aside)

    def acquire(self) -> None:
        end = time.monotonic() + self.timeout
        while not self.held:
            self._remove_leftover()
            if self.files.create(NAME, self.mark):
                self.held = True
                return
            if time.monotonic() >= end:
                raise LockTimeout(f"another process holds {self.path}")
            time.sleep(min(self.poll, max(0.0, end - time.monotonic())) or 0.01)

    def release(self) -> None:
        if self.held:
            if self.files.read_text(NAME) == self.mark:
                self.files.delete(NAME)
            self.held = False

    def __enter__(self) -> IndexLock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
