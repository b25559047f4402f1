"""The built-in evaluation set: sixty questions made from six templates and ten teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qanat.functions import arabic_rules as ar

#: intent -> (question, reference answer); ``{t}`` is a team, ``{o}`` the next one.
TEMPLATES = {
    "lineup": ("ما هو تشكيل {t} أمام {o}؟", "أعلن {t} تشكيل الفريق لمباراة {o}."),
    "match_result": ("ما نتيجة مباراة {t} و{o}؟", "انتهت مباراة {t} و{o}."),
    "transfer_news": ("ما أحدث صفقات {t} في الانتقالات؟", "تعاقد {t} مع لاعب جديد."),
    "team_news": ("ما آخر أخبار مران {t}؟", "واصل {t} مرانه استعدادا للمباراة المقبلة."),
    "general_football": ("ما الجديد عن {t} هذا الموسم؟", "يستعد {t} لمبارياته المقبلة هذا الموسم."),
    "player_info": ("ما موقف إصابة لاعب {t}؟", "يواصل لاعب {t} برنامجه العلاجي."),
}
LEVELS = ["easy", "medium", "hard"]
TEAMS = 10


def default_cases(spark: SparkSession) -> DataFrame:
    """question, reference, intent, difficulty, keywords, expected_refusal."""
    from qanat.plans.evaluation import CASES

    names = [name for name, _ in ar.TEAMS][: TEAMS + 1]
    rows = []
    for intent, (question, answer) in TEMPLATES.items():
        for i, (team, other) in enumerate(zip(names, names[1:])):
            rows.append((question.format(t=team, o=other), answer.format(t=team, o=other), intent, LEVELS[i % 3], [team], False))
    return spark.createDataFrame(rows, CASES)
