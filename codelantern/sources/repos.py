"""Repository addresses and the fetch step on the driver."""

from __future__ import annotations

import os
import re
import shutil
import stat
import subprocess
import tempfile
from pathlib import Path
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.functions.text import trim_space

# Host and path; tolerant of characters that java.net.URI refuses.
URL_PARTS = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]+)?([^?#]*)"


def parse_repo_urls(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host, owner, repo, repo_id, clone_url, status`` for a column of addresses.

    One trailing ``.git`` goes first, then one trailing slash; ``owner/repo``
    is accepted as is.  ``status`` is ``ok``, ``invalid_host`` or ``invalid_url``.
    """
    text = trim_space(F.col(url))
    text = F.regexp_replace(F.regexp_replace(text, r"\.git\z", ""), r"/\z", "")
    short = text.rlike(fv.REPO_SHORTHAND)
    host = F.lower(F.nullif(F.regexp_extract(text, URL_PARTS, 1), F.lit("")))
    parts = F.filter(F.split(F.regexp_extract(text, URL_PARTS, 2), "/"), lambda p: p != "")

    def piece(n: int) -> Column:
        return F.when(short, F.regexp_extract(text, fv.REPO_SHORTHAND, n + 1)).otherwise(F.get(parts, F.lit(n)))

    known = host.isin(*fv.REPO_HOSTS)
    status = (
        F.when(short, "ok").when(host.isNull(), "invalid_url").when(~known, "invalid_host")
        .when(F.size(parts) < 2, "invalid_url").otherwise("ok")
    )
    ok = F.col("status") == "ok"
    repo_id = F.concat(F.col("owner"), F.lit("/"), F.col("repo"))
    return (
        rows.withColumn("status", status).withColumn("host", host)
        .withColumn("owner", F.when(ok, piece(0))).withColumn("repo", F.when(ok, piece(1)))
        .withColumn("repo_id", repo_id)
        .withColumn("clone_url", F.concat(F.lit("https://github.com/"), repo_id, F.lit(".git")))
    )


class RepoAddress(NamedTuple):
    owner: str
    repo: str

    @property
    def repo_id(self) -> str:
        return f"{self.owner}/{self.repo}"

    @property
    def clone_url(self) -> str:
        return f"https://github.com/{self.repo_id}.git"


def parse_repo_url(address: str) -> RepoAddress:
    """The same rules for one address on the driver; raises ``ValueError`` when it is not usable."""
    text = address.strip().removesuffix(".git").removesuffix("/")
    match = re.fullmatch(fv.REPO_SHORTHAND[1:-1], text)
    if match:
        return RepoAddress(*match.groups())
    url = urlsplit(text)
    if url.scheme and url.hostname and url.hostname not in fv.REPO_HOSTS:
        raise ValueError(f"unsupported host: {url.hostname}")
    parts = [p for p in url.path.split("/") if p]
    if not url.scheme or not url.hostname or len(parts) < 2:
        raise ValueError(f"not a repository address: {address}")
    return RepoAddress(parts[0], parts[1])


class RepoTooLarge(ValueError):
    pass


def tree_size(root: Path) -> int:
    return sum(p.stat().st_size for p in root.rglob("*") if p.is_file() and not p.is_symlink())


def check_size(repo_id: str, root: Path, max_bytes: int = fv.MAX_REPO_SIZE_BYTES) -> int:
    size = tree_size(root)
    if size > max_bytes:
        raise RepoTooLarge(f"{repo_id} has {size} bytes, more than the {max_bytes} allowed")
    return size


def shallow_clone(address: str, parent: Path, max_bytes: int = fv.MAX_REPO_SIZE_BYTES) -> tuple[str, Path]:
    """Probe and clone one public repository into a new folder below ``parent``, which executors have to reach: ``(repo_id, root)``."""
    repo = parse_repo_url(address)
    target = Path(tempfile.mkdtemp(prefix=f"{repo.owner}_{repo.repo}-", dir=parent)) / "tree"
    try:
        subprocess.run(["git", "ls-remote", "--heads", repo.clone_url], check=True, capture_output=True)
        subprocess.run(["git", "clone", "--depth", "1", repo.clone_url, str(target)], check=True, capture_output=True)
        check_size(repo.repo_id, target, max_bytes)
    except BaseException:
        remove_tree(target.parent)
        raise
    return repo.repo_id, target


def remove_tree(root: Path) -> None:
    """Delete a fetched tree.  Every folder is opened first, as deleting a file needs write access to its folder."""
    if not root.exists():
        return
    root.chmod(stat.S_IRWXU)
    for folder, names, _ in os.walk(root):
        for name in names:
            path = Path(folder, name)
            if not path.is_symlink():
                path.chmod(stat.S_IRWXU)
    shutil.rmtree(root)
