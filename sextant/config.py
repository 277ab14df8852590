"""Layered configuration: flags over project file over user file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

# The public defaults of the embedding service.
DEFAULT_ENDPOINT = "http://localhost:11434"
DEFAULT_CODE_MODEL = "code-embedding"
DEFAULT_TEXT_MODEL = "text-embedding"


@dataclass(frozen=True)
class Config:
    endpoint: str = DEFAULT_ENDPOINT
    api_key: str = ""
    code_model: str = DEFAULT_CODE_MODEL
    text_model: str = DEFAULT_TEXT_MODEL

    def merged(self, other: dict) -> "Config":
        """Non-empty values of ``other`` win; unknown keys are left alone."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in other.items() if k in known and v})

    def validated(self) -> "Config":
        """Checks the endpoint and models and drops one trailing slash (and a trailing ``/v1``)."""
        if not self.endpoint:
            raise ValueError("endpoint is empty")
        if not self.endpoint.startswith(("http://", "https://")):
            raise ValueError("endpoint must begin with http:// or https://")
        for name in ("code_model", "text_model"):
            if not getattr(self, name):
                raise ValueError(f"{name} is empty")
        url = self.endpoint.removesuffix("/").removesuffix("/v1")
        return replace(self, endpoint=url)

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            json.dump(asdict(self), out, indent=2)


def _read(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        try:
            found = json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} is not valid JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a JSON object")
    return found


def load(user_file: str, project_file: str, flags: dict | None = None) -> Config:
    """Precedence: flag, project file, user file, default."""
    config = Config()
    for layer in (_read(user_file), _read(project_file), flags or {}):
        config = config.merged(layer)
    return config.validated()
