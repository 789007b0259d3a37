"""Definition files: tasks, corpus texts, models, interventions. Unknown keys and dangling references are errors before anything runs."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schema import NO_MODEL, SCHEMES, check_id

#: The keys of definition files; those with a star must be there.
TASK = {"id": str, "category": str, "title": str, "prompt": str, "audience": str, "tags": list}
TASK_NEEDS = ("id", "category", "title", "prompt")
CORPUS = {"id": str, "title": str, "note": str, "audience": str, "tags": list}
MODEL = {"id": str, "provider": ("anthropic", "openai", "mock"), "model": str, "label": str, "apiKeyEnv": str, "baseUrl": str, "maxTokens": (int, float), "temperature": (int, float), "thinking": ("adaptive", "none"), "effort": ("low", "medium", "high", "xhigh", "max"), "fallbacks": bool, "mockStyle": str}
MODEL_NEEDS = ("id", "provider", "model")
INTERVENTION = {"id": str, "name": str, "description": str, "steps": list}
STEPS = {
    "generate": ({"type": str, "reuse": str, "system": str, "promptPrefix": str, "promptSuffix": str}, ("type",)),
    "textlint-fix": ({"type": str, "config": str}, ("type",)),
    "rewrite": ({"type": str, "prompt": str, "model": str, "passes": int}, ("type", "prompt")),
}


class DefinitionError(ValueError):
    """A definition file is not as it must be."""


def _yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def strict(item: Any, fields: dict[str, Any], needs: tuple[str, ...], where: str) -> dict[str, Any]:
    """item if it is a mapping with known keys of the right kinds."""
    if not isinstance(item, dict):
        raise DefinitionError(f"{where}: a mapping is needed")
    for key in item:
        if key not in fields:
            raise DefinitionError(f"{where}: unknown key {key!r}")
    for key in needs:
        if item.get(key) is None:
            raise DefinitionError(f"{where}: {key} is missing")
    for key, value in item.items():
        kind = fields[key]
        named = isinstance(kind, tuple) and isinstance(kind[0], str)
        if named and value not in kind or not named and not isinstance(value, kind) or kind is int and (isinstance(value, bool) or value < 1):
            raise DefinitionError(f"{where}: {key} cannot be {value!r}")
        if kind is list and key == "tags" and not all(isinstance(x, str) for x in value):
            raise DefinitionError(f"{where}: tags are strings")
    return item


def files(folder: str | Path, suffix: str) -> list[Path]:
    """Files of a folder by name, without those that begin with an underscore; a missing folder has none."""
    folder = Path(folder)
    return sorted(p for p in folder.iterdir() if p.suffix == suffix and not p.name.startswith("_")) if folder.is_dir() else []


def unique(items: list[dict], kind: str) -> list[dict]:
    seen: set[str] = set()
    for item in items:
        if item["id"] in seen:
            raise DefinitionError(f"{kind} {item['id']!r} is defined twice")
        seen.add(item["id"])
    return items


def load_tasks(folder: str | Path) -> list[dict]:
    out = [strict(_yaml(p.read_text("utf-8")), TASK, TASK_NEEDS, p.name) for p in files(folder, ".yaml")]
    for t in out:
        check_id(t["id"])
    return unique(out, "task")


def parse_corpus(text: str, name: str) -> dict:
    """A text with an optional block of fields between --- lines; id and title default to the file's name."""
    lines = text.replace("\r\n", "\n").split("\n")
    fields: dict = {}
    if lines[0].strip() == "---":
        end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
        if end is None:
            raise DefinitionError(f"{name}: the block of fields is not closed")
        fields = strict(_yaml("\n".join(lines[1:end])) or {}, CORPUS, (), name)
        lines = lines[end + 1 :]
    stem = Path(name).stem
    out = {"id": stem, "title": stem} | fields | {"text": "\n".join(lines).strip()}
    check_id(out["id"])
    return out


def load_corpus(folder: str | Path) -> list[dict]:
    return unique([parse_corpus(p.read_text("utf-8"), p.name) for p in files(folder, ".md")], "text")


def load_models(path: str | Path) -> dict:
    """{"models": […], "judge": {"model": id}}."""
    data = strict(_yaml(Path(path).read_text("utf-8")), {"models": list, "judge": dict}, ("models", "judge"), str(path))
    strict(data["judge"], {"model": str}, ("model",), "judge")
    for m in data["models"]:
        strict(m, MODEL, MODEL_NEEDS, "model")
        check_id(m["id"], (NO_MODEL,))
    unique(data["models"], "model")
    return data


def check_step(step: Any, where: str) -> dict:
    kind = step.get("type") if isinstance(step, dict) else None
    if kind not in STEPS:
        raise DefinitionError(f"{where}: unknown step {kind!r}")
    strict(step, *STEPS[kind], where)
    if step.get("reuse") and any(step.get(k) for k in ("system", "promptPrefix", "promptSuffix")):
        raise DefinitionError(f"{where}: reuse goes with no prompt")
    return step


def load_interventions(folder: str | Path, models: list[dict] | None = None) -> list[dict]:
    out = []
    for p in files(folder, ".yaml"):
        item = strict(_yaml(p.read_text("utf-8")), INTERVENTION, ("id", "name", "steps"), p.name)
        check_id(item["id"])
        if not item["steps"]:
            raise DefinitionError(f"{p.name}: no steps")
        out.append(item | {"steps": [check_step(s, p.name) for s in item["steps"]], "dir": str(p.parent)})
    return check_references(unique(out, "intervention"), models)


def check_references(interventions: list[dict], models: list[dict] | None = None) -> list[dict]:
    """Reuse names other interventions that exist, pinned models exist, and rewriting templates take a text."""
    ids = {i["id"] for i in interventions}
    for i in interventions:
        for s in i["steps"]:
            if reuse := s.get("reuse"):
                if reuse not in ids or reuse == i["id"]:
                    raise DefinitionError(f"{i['id']}: cannot reuse {reuse!r}")
            if s["type"] == "rewrite":
                if models is not None and s.get("model") and s["model"] not in {m["id"] for m in models}:
                    raise DefinitionError(f"{i['id']}: no model {s['model']!r}")
                template = Path(i.get("dir", "."), s["prompt"])
                if template.is_file() and "{{text}}" not in template.read_text("utf-8").replace(" ", ""):
                    raise DefinitionError(f"{template}: {{{{text}}}} is missing")
    return interventions


def load_sources(tasks: list[dict], corpus: list[dict]) -> list[dict]:
    """Tasks and texts as one list; an id is used once among both."""
    return unique([{"sourceType": "task"} | t for t in tasks] + [{"sourceType": "corpus"} | c for c in corpus], "source")


def pick(items: list[dict], ids: list[str] | None, kind: str) -> list[dict]:
    """All items, or those of some ids in the order asked for, repeats included."""
    if ids is None:
        return items
    by_id = {i["id"]: i for i in items}
    for x in ids:
        if x not in by_id:
            raise DefinitionError(f"no {kind} {x!r}; there are: {', '.join(by_id)}")
    return [by_id[x] for x in ids]


def parse_list(value: str | None) -> list[str] | None:
    if value is None:
        return None
    parts = [p.strip() for p in value.split(",") if p.strip()]
    if not parts:
        raise DefinitionError("an empty list")
    return parts


def parse_schemes(value: str | None) -> list[str]:
    out = list(dict.fromkeys(parse_list(value) or SCHEMES))
    for s in out:
        if s not in SCHEMES:
            raise DefinitionError(f"no scheme {s!r}; there are: {', '.join(SCHEMES)}")
    return out


def parse_count(value: str | int, least: int = 1) -> int:
    """A whole number of at least `least`."""
    try:
        n = int(str(value))
    except ValueError:
        n = least - 1
    if n < least or str(n) != str(value).strip():
        raise DefinitionError(f"not a number of at least {least}: {value!r}")
    return n


def source_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    fields = ("id", "sourceType", "title", "audience", "prompt", "text")
    return spark.createDataFrame([tuple(s.get(f) for f in fields) for s in sources], ", ".join(f"{f} string" for f in fields))


def duplicate_ids(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*key).count().filter("count > 1")


def missing_references(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key the target does not have."""
    return df.join(target.select(target.columns), df[key] == target[target_key], "left_anti")
