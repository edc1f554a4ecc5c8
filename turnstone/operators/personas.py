"""Personas: limits, the context that goes before a conversation, and what becomes of an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from . import scenes

# Texts that results must match.
MEMORY_NOTE, TIME_NOTE, UNKNOWN_SCENE, UNKNOWN_MODEL = "【用户记忆参考】", "当前时间：", "未知场景", "unknown"


@dataclass(frozen=True)
class Persona:
    """What a persona is run with. before: its context in order; after: its steps over an answer; tools: None for all, else a whitelist's (scene) or none."""

    name: str
    prompt: str
    model: str = UNKNOWN_MODEL
    iterations: int = 10
    window: int = 50
    memory: str = "PERSISTENT"
    timeout_s: int = 30
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    tools: str | None = None
    ends_on: tuple[str, ...] = ("no_calls",)

    def __post_init__(self):
        if not self.name or not self.prompt or not self.ends_on:
            raise ValueError("a persona needs a name, a prompt and an end")
        object.__setattr__(self, "model", self.model or UNKNOWN_MODEL)


# Limits and chains of the personas.
PERSONAS = {
    p.name: p
    for p in (
        Persona("chat", "system/assistant_default", "qwen-turbo", before=("memory", "vehicle_status", "time"), after=("same", "same"), ends_on=("no_calls", "vetoed")),
        Persona("scene", "system/assistant_scene", "qwen-flash", 2, memory="EPHEMERAL", timeout_s=20, before=("scene", "vehicle_status", "active_control"), after=("scene_action",), tools="scene"),
        Persona("vision_qa", "task/front_view_qa", "qwen-vl-max", 1, 2, "NONE", 20, after=("vision_warning",), tools="none"),
    )
}


def before(step: str, templates: dict[str, str] | None = None) -> Column:
    """The user message that a step puts before the conversation, of a run's columns (iteration, memory_text, vehicle_status, ts, scene, scene_text); null for none."""
    known = text.TEMPLATES | (templates or {})
    if step == "memory":  # in the first iteration only
        return F.when((F.col("iteration") == 0) & (F.coalesce("memory_text", F.lit("")) != ""), F.concat(F.lit(MEMORY_NOTE), F.col("memory_text")))
    if step == "vehicle_status":
        return text.render(F.lit(known["user/vehicle_status"]), {"vehicle_status": F.col("vehicle_status")})
    if step == "time":
        return F.concat(F.lit(TIME_NOTE), text.time_line(F.col("ts")))
    if step == "scene":
        shown = F.when(F.col("scene").isNull(), F.lit(UNKNOWN_SCENE)).otherwise(jsonx.scene_json(F.col("scene"), F.col("scene_text")))
        return text.render(F.lit(known["user/scene_description"]), {"scene_description": shown})
    if step == "vision_warning":
        return F.lit(text.VISION_WARNING)
    return F.lit(known[f"user/{step}"])


def context(runs: DataFrame, persona: Persona, templates: dict[str, str] | None = None) -> DataFrame:
    """memory_id, run_id, chain_pos, type, text: the transient messages of each run, in the order of the chain; steps that say nothing leave no row."""
    said = F.array(*[F.struct(F.lit(k + 1).alias("chain_pos"), F.lit("user").alias("type"), before(s, templates).alias("text")) for k, s in enumerate(persona.before)])
    if not persona.before:
        return runs.select("memory_id", "run_id", F.lit(0).alias("chain_pos"), F.lit("user").alias("type"), F.lit("").alias("text")).limit(0)
    return runs.select("memory_id", "run_id", F.inline(F.filter(said, lambda m: m["text"].isNotNull())))


def after(answer: Column, persona: Persona, scene: Column | None = None, summary: Column | None = None) -> Column:
    """The answer after the chain, from left to right. A scene's fixed action is merged in by summary, which a model makes of both."""
    for step in persona.after:
        if step == "vision_warning":
            answer = text.with_vision_warning(answer)
        elif step == "scene_action" and scene is not None:
            action = scenes.action(scene)
            answer = scenes.merged(answer, action, summary if summary is not None else F.concat(answer, action))
    return answer


def runtime(turns: DataFrame) -> DataFrame:
    """user_id, n_compactions, last_tokens from turns (user_id, ts, ord, compacted, token_estimate)."""
    return turns.groupBy("user_id").agg(F.count_if("compacted").alias("n_compactions"), F.max_by("token_estimate", F.struct("ts", "ord")).alias("last_tokens"))
