"""Settings of a store: a TOML file, then environment variables, over defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import SparkSession

from tidepool.sources.tables import backend_root


@dataclass
class Server:
    region: str = "us-east-1"


@dataclass
class Storage:
    backend: str = "fs"
    root: str = "./data"
    bucket: str = ""
    container: str = ""
    account: str = ""

    @property
    def address(self) -> str:
        given = {k: v for k, v in (("root", self.root), ("bucket", self.bucket), ("container", self.container), ("account", self.account)) if v}
        return backend_root(self.backend, **given)


@dataclass
class SignIn:
    enabled: bool = False
    session_secret: str = ""
    session_ttl_secs: int = 86_400
    allowed_domains: list[str] = field(default_factory=list)
    allowed_emails: list[str] = field(default_factory=list)


@dataclass
class Retention:
    interval_secs: int = 60
    grace_secs: int = 300
    multipart_expiry_secs: int = 86_400

    @property
    def every(self) -> int:
        """Seconds between sweeps: never fewer than 5."""
        return max(5, self.interval_secs)


@dataclass
class Settings:
    server: Server = field(default_factory=Server)
    storage: Storage = field(default_factory=Storage)
    oidc: SignIn = field(default_factory=SignIn)
    gc: Retention = field(default_factory=Retention)


def _typed(raw: object, now: object) -> object:
    """A setting as its default's type; environment variables bring text."""
    if not isinstance(raw, str) or isinstance(now, str):
        if type(raw) is not type(now):
            raise ValueError(f"{raw!r} where {type(now).__name__} belongs")
        return raw
    if isinstance(now, bool):
        if raw.lower() not in ("true", "false"):
            raise ValueError(f"{raw!r} is neither true nor false")
        return raw.lower() == "true"
    if isinstance(now, list):
        return [x.strip() for x in raw.strip("[]").split(",") if x.strip()]
    return int(raw)


def _merge(into: object, given: Mapping[str, object]) -> None:
    for f in fields(into):
        if f.name in given:
            now, raw = getattr(into, f.name), given[f.name]
            if is_dataclass(now) and isinstance(raw, Mapping):
                _merge(now, raw)
            else:
                setattr(into, f.name, _typed(raw, now))


def load(path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "TIDEPOOL") -> Settings:
    """Defaults, then the file (PREFIX_CONFIG, or one of the prefix's name here; a missing one is passed over), then PREFIX__SECTION__NAME. Unknown names are ignored."""
    environment = os.environ if environment is None else environment
    path = path or environment.get(f"{prefix}_CONFIG", f"{prefix.lower()}.toml")
    found = Settings()
    if os.path.exists(path):
        with open(path, "rb") as f:
            _merge(found, tomllib.load(f))
    for name, value in environment.items():
        parts = name.lower().split("__")
        if len(parts) == 3 and parts[0] == prefix.lower():
            _merge(found, {parts[1]: {parts[2]: value}})
    return found


def healthy(spark: SparkSession, address: str) -> bool:
    """Whether the backend at an address answers and its root is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(address)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
