"""Tables of an evaluation run, identifiers, and the metrics' directions."""

from __future__ import annotations

import re

STEP = "struct<type:string,skipped:boolean,ms:bigint,modelId:string,servedBy:string,reusedFrom:string,reusedHash:string,applied:int,remaining:int,usage:struct<inputTokens:bigint,outputTokens:bigint>>"
SAMPLES = f"id string, runId string, sourceType string, sourceId string, modelId string, interventionId string, sampleIndex int, text string, inputText string, inputHash string, steps array<{STEP}>, createdAt string, error string"
SCORES = "sampleId string, textHash string, scoringHash string, sourceId string, modelId string, interventionId string, metrics map<string,double>, textlintRules map<string,bigint>, textlintMessages array<struct<ruleId:string,message:string,line:int,column:int,fixable:boolean>>"
RUBRIC = "readability int, clarity int, naturalness int, concision int, structure int, overall int"
JUDGMENTS = (
    "kind string, sampleId string, textHash string, scheme string, sourceId string, aSampleId string, bSampleId string, aTextHash string, bTextHash string, contextHash string, judgeConfigHash string, judgeModel string, "
    f"promptVersion string, scores struct<{', '.join(':'.join(x.split()) for x in RUBRIC.split(', '))}>, verdictAB string, verdictBA string, verdict string, rationale string, createdAt string"
)
PAIRS = "id string, sourceId string, scheme string, aSampleId string, bSampleId string, aText string, bText string, taskTitle string, audience string"
VOTES = "pairId string, choice string, leftWasA boolean, raterId string, comment string, seconds double, createdAt string"

#: What definitions, hashes and reports are read and written with.
DEFAULT_AUDIENCE = "一般的な読者"
NO_MODEL = "none"
METRICS_VERSION, PIPELINE_VERSION, RUBRIC_VERSION, PAIRWISE_VERSION = "metrics-v2", "pipeline-v1", "rubric-v2", "pairwise-v2"
SCHEMES = ("interventions", "models")
LOWER = ("textlintPer1k", "textlintCount", "meanSentenceLength", "maxSentenceLength", "longSentenceRatio", "veryLongSentenceRatio", "tenPerSentence", "manyTenRatio", "maxKanjiRun", "kanjiRatio", "kangoRatio", "rareruPerSentence", "nominalizationPer1k")
HEADLINE = ("textlintPer1k", "meanSentenceLength", "longSentenceRatio", "tenPerSentence", "kanjiRatio", "jreadability")
RUBRIC_KEYS = ("readability", "clarity", "naturalness", "concision", "structure", "overall")

ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.+-]*")
RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def judge_key(rubric_key: str) -> str:
    return "judge" + rubric_key[0].upper() + rubric_key[1:]


def check_id(value: str, reserved: tuple[str, ...] = ()) -> str:
    """An identifier of a source, model or intervention."""
    if not ID.fullmatch(value) or "__" in value or value in reserved:
        raise ValueError(f"not a usable id: {value!r}")
    return value


def check_run_id(value: str) -> str:
    if not RUN_ID.fullmatch(value) or ".." in value:
        raise ValueError(f"not a usable run id: {value!r}")
    return value
