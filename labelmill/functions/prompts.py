"""Prompt templates and their rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Templates hold {placeholders}; each row fills them from its own columns.
EDGE_TEMPLATE = (
    "Write hard test texts for the class {class_label} of a {classification_type} classifier. "
    "The task is: {problem}. The classes are: {classes}. Each text must belong to {class_label} "
    "yet look borderline, indirect or unusual. Answer in {language} with a JSON object whose keys are numbers."
)
REFINE_TEMPLATE = (
    "The task is: {problem} ({classification_type}; classes: {classes}). Judge the samples below against the "
    "prompts {prompts} and return JSON with evaluation_summary and refined_prompts.\n{samples}"
)
REVIEW_TEMPLATE = (
    "The task is: {problem} ({classification_type}; classes: {classes}). The data came from the prompts {prompts}. "
    "Name weak and strong sides of the model and better prompts, given these results:\n{results}"
)
SINGLE_SYSTEM = "Answer only with realistic short texts in {language}: 50 texts, one per line, no labels."
MULTI_SYSTEM = (
    "Answer only with realistic short texts in {language} to which several labels apply at once: "
    "50 texts, one per line, no labels."
)
ACTIVATION_NOTES = {
    "sigmoid": "Several labels may hold for one text: design a multi-label task.",
    "softmax": "Exactly one label holds for a text: design a single-label task.",
    "auto": "Choose the kind of task that suits the description.",
}


def render(template: Column | str, **values: Column) -> Column:
    """Fill each ``{name}`` of the template with the column given under that name."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def system_prompt(task: Column, language: Column, activation: Column) -> Column:
    """Data-generation instruction: the multi-label form for multi-label tasks or sigmoid preference."""
    multi = F.contains(F.coalesce(task, F.lit("")), F.lit("multilabel")) | (activation == "sigmoid")
    return render(F.when(multi, F.lit(MULTI_SYSTEM)).otherwise(F.lit(SINGLE_SYSTEM)), language=language)


def activation_note(activation: Column) -> Column:
    """Sentence added to the configuration request for the user's activation preference."""
    return (
        F.when(activation == "sigmoid", ACTIVATION_NOTES["sigmoid"])
        .when(activation == "softmax", ACTIVATION_NOTES["softmax"])
        .otherwise(ACTIVATION_NOTES["auto"])
    )
