"""Table functions: one input row to none or many."""

from __future__ import annotations

import json

from pyspark.sql.functions import udtf


@udtf(returnType="at int, text string, score double")
class RecognizedTexts:
    """Texts and scores of one recognizer result, a JSON object with rec_texts and rec_scores; null or neither of them gives no rows."""

    def eval(self, result: str):
        found = json.loads(result) if result else {}
        for k, (text, score) in enumerate(zip(found.get("rec_texts") or [], found.get("rec_scores") or [])):  # noqa: B905
            yield k, text, float(score)
