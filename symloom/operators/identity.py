"""Where a working directory belongs, and where its cache lies."""

from __future__ import annotations

import hashlib
import os
import subprocess
from dataclasses import dataclass


@dataclass(frozen=True)
class Identity:
    repo_id: str
    worktree_key: str
    working_dir: str
    source: str  # commits, remotes or path


def cache_root(env: dict[str, str] | None = None) -> str:
    """The folder of caches: by SYMLOOM_CACHE_DIR, else XDG_CACHE_HOME, else below the home folder."""
    e = os.environ if env is None else env
    if e.get("SYMLOOM_CACHE_DIR"):
        return e["SYMLOOM_CACHE_DIR"]
    base = e.get("XDG_CACHE_HOME") or os.path.join(e.get("HOME", "/"), ".cache")
    return os.path.join(base, "symloom")


def plain_remote(url: str) -> str:
    url = url.strip().rstrip("/").removesuffix(".git")
    if url.startswith("git@") and ":" in url:
        host, _, path = url[4:].partition(":")
        url = f"https://{host}/{path}"
    return url.lower()


def _hash(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def common_dir(working_dir: str) -> str | None:
    """The directory all worktrees of a repository share, or None outside of one."""
    git = os.path.join(working_dir, ".git")
    if os.path.isfile(git):  # a linked worktree names its own folder
        with open(git) as f:
            line = f.read().strip()
        if not line.startswith("gitdir:"):
            return None
        git = os.path.join(working_dir, line[7:].strip())
    if not os.path.isdir(git):
        return None
    shared = os.path.join(git, "commondir")
    if os.path.isfile(shared):
        with open(shared) as f:
            git = os.path.join(git, f.read().strip())
    return os.path.realpath(git)


def _git(working_dir: str, *args: str) -> list[str]:
    try:
        run = subprocess.run(["git", "-C", working_dir, *args], capture_output=True, text=True, timeout=20, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return run.stdout.split("\n") if run.returncode == 0 else []


def detect(working_dir: str) -> Identity:
    """By root commits and remotes, else remotes, else the path."""
    working_dir = os.path.realpath(working_dir)
    shared = common_dir(working_dir)
    roots = sorted({x for x in _git(working_dir, "rev-list", "--max-parents=0", "HEAD") if x}) if shared else []
    remotes = sorted({plain_remote(x.split(" ", 1)[1]) for x in _git(working_dir, "config", "--get-regexp", r"^remote\..*\.url$") if " " in x}) if shared else []
    if roots:
        repo, source = _hash(*roots, *remotes), "commits"
    elif remotes:
        repo, source = _hash(*remotes), "remotes"
    else:
        repo, source = _hash(shared or working_dir), "path"
    return Identity(repo, _hash(repo, shared or "", working_dir), working_dir, source)
