"""Rules of severity, weather risk, routing and display, as case expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.labels import is_healthy


def gate(conf: Column, threshold: float = 0.95) -> Column:
    """Shown if the confidence reaches the threshold."""
    return conf >= threshold


def route(triage: Column, triage_conf: Column, disease_conf: Column, threshold: float = 0.95) -> Column:
    """failure without a triage answer, retake below the gate, questionnaire for pest damage,
    else the disease model, gated again (healthy plants too)."""
    return (
        F.when(triage.isNull(), "failure")
        .when(~gate(triage_conf, threshold), "retake")
        .when(triage == "pest_damage", "questionnaire")
        .when(gate(disease_conf, threshold), "result")
        .otherwise("retake")
    )


def low_confidence_message(conf: Column, threshold: float = 0.95) -> Column:
    """Null where the answer is shown."""
    return F.when(~gate(conf, threshold), F.format_string("Not sure enough (%.1f%%); please take another picture.", conf * 100))


def severity(name: Column, conf: Column) -> Column:
    """struct<stage, percent>: healthy 0, below 0.60 first, to 0.85 second, above third stage."""
    pick = lambda stage, percent: F.struct(F.lit(stage).alias("stage"), F.lit(percent).alias("percent"))
    return F.when(is_healthy(name), pick(0, 0)).when(conf < 0.60, pick(1, 15)).when(conf <= 0.85, pick(2, 40)).otherwise(pick(3, 75))


def app_stage(healthy: Column) -> Column:
    return F.struct(F.when(healthy, 0).otherwise(1).alias("stage"), F.when(healthy, 0).otherwise(20).alias("percent"))


def history_stage(stage: Column) -> Column:
    """struct<stage, percent, urgency> of a stored stage text; anything else, healthy included,
    is the first stage."""
    s = F.lower(stage)
    pick = lambda n, p, u: F.struct(F.lit(n).alias("stage"), F.lit(p).alias("percent"), F.lit(u).alias("urgency"))
    return F.when(s.contains("severe"), pick(3, 75, "high")).when(s.contains("moderate"), pick(2, 40, "medium")).otherwise(pick(1, 15, "low"))


def history_level(stage: Column, healthy: Column) -> Column:
    s = F.lower(stage)
    return F.when(healthy, 0).when(s.contains("high"), 3).when(s.contains("medium"), 2).otherwise(1)


def weather_risk(disease: Column, humidity: Column, rain_slots: Column) -> Column:
    """Fungal diseases (blight, mold, rust): above 75 % with two rainy slots HIGH, above 60 %
    MODERATE, else LOW; others by 80 and 60 %; UNKNOWN without a humidity."""
    fungal = F.lower(disease).rlike("blight|mold|rust")
    return (
        F.when(humidity.isNull(), "UNKNOWN")
        .when(fungal, F.when((humidity > 75) & (rain_slots >= 2), "HIGH").when(humidity > 60, "MODERATE").otherwise("LOW"))
        .otherwise(F.when(humidity > 80, "HIGH").when(humidity > 60, "MODERATE").otherwise("LOW"))
    )


def app_risk(humidity: Column) -> Column:
    return F.when(humidity > 80, "HIGH").when(humidity > 60, "MODERATE").otherwise("LOW")


#: By the app's risk, the percentage points that an affected area may grow by, and how soon to treat.
APP_GROWTH = {"HIGH": (20, 35), "MODERATE": (10, 20), "LOW": (0, 10)}
APP_URGENCY = {"HIGH": "Treat within 24 hours", "MODERATE": "Treat within 3 days", "LOW": "Monitor closely"}
#: What the app says of a risk, and its names for the risks.
APP_RISK_TEXT = "Over the next 7 days, %s has a %s spread risk. If untreated, the affected area could increase by about %d-%d percentage points from the current ~%d%%. This is a weather-based estimate; recheck the plant in 2-3 days."
APP_NO_DISEASE = "No disease detected. Over the next 7 days, weather-based spread risk is low."
APP_RISK_NAME = {"HIGH": "High", "MODERATE": "Medium", "LOW": "Low"}
#: What the service says of a weather risk, for fungal diseases and others, and of a weak answer.
SERVICE_TEXT = {
    (True, "HIGH"): "Rain expected in %d days will accelerate %s spread", (True, "MODERATE"): "Moderate humidity may support %s development", (True, "LOW"): "Conditions are not favorable for %s spread",
    (False, "HIGH"): "High humidity creates favorable conditions for %s", (False, "MODERATE"): "Monitor %s progression under current conditions", (False, "LOW"): "Low risk environment for %s",
}
WEAK_TEXT = "Low confidence (%s%%). Retake the photo with a single leaf filling the frame in even light."


def _by_risk(risk: Column, of) -> Column:
    out = F.lit(None)
    for name in APP_GROWTH:
        out = F.when(risk == name, of(name)).otherwise(out)
    return out


def app_risk_report(humidity: Column, disease: Column, area: Column, healthy: Column) -> Column:
    """struct<risk, low, high, urgency, message>: the app's risk by humidity, the points that the affected area may grow by, how soon
    to treat, and what it says. The area is cut to 0 to 100 and to whole points; none is 0."""
    risk = app_risk(humidity)
    points = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(area.cast("double"), F.lit(0.0)))).cast("int")
    said = _by_risk(risk, lambda r: F.format_string(APP_RISK_TEXT, disease, F.lit(APP_RISK_NAME[r]), F.lit(APP_GROWTH[r][0]), F.lit(APP_GROWTH[r][1]), points))
    return F.struct(
        risk.alias("risk"), _by_risk(risk, lambda r: F.lit(APP_GROWTH[r][0])).alias("low"), _by_risk(risk, lambda r: F.lit(APP_GROWTH[r][1])).alias("high"),
        _by_risk(risk, lambda r: F.lit(APP_URGENCY[r])).alias("urgency"), F.when(F.coalesce(healthy, F.lit(False)), APP_NO_DISEASE).otherwise(said).alias("message"),
    )


def weather_message(disease: Column, humidity: Column, rain_slots: Column) -> Column:
    """What the service says of weather_risk(); null where that is unknown. Underscores of the disease are shown as blanks."""
    fungal, risk, shown = F.lower(disease).rlike("blight|mold|rust"), weather_risk(disease, humidity, rain_slots), F.replace(disease, F.lit("_"), F.lit(" "))
    out = F.lit(None)
    for (of_fungi, name), text in SERVICE_TEXT.items():
        values = [rain_slots.cast("int"), shown] if text.count("%") == 2 else [shown]
        out = F.when((fungal == F.lit(of_fungi)) & (risk == name), F.format_string(text, *values)).otherwise(out)
    return out


def retake_message(conf: Column, threshold: float = 0.95) -> Column:
    """What the service says of an answer below the gate, with its percentage to one decimal; null where the answer is shown."""
    return F.when(~gate(conf, threshold), F.format_string(WEAK_TEXT, F.format_string("%.1f", percent(conf))))


def badge(percent: Column) -> Column:
    return F.when(percent >= 85, "high").when(percent >= 60, "medium").otherwise("low")


def percent(conf: Column) -> Column:
    """To one decimal, halves away from zero."""
    return F.round(conf * 100, 1)


def steps(text: Column) -> Column:
    """array<struct<n, step>>: sentences and lines, trimmed, without leading hyphens."""
    parts = F.filter(F.transform(F.split(text, r"(?<=\.)\n?|\n"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^-+\s*", ""))), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct((i + 1).cast("int").alias("n"), p.alias("step")))


def day_label(text: Column) -> Column:
    """Short day name of a yyyy-MM-dd HH:mm:ss text, or its first three characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), "EEE"), F.substring(text, 1, 3))


def date_label(millis: Column) -> Column:
    """Years of more than four digits have no sign, as the app shows them."""
    return F.replace(F.date_format(F.timestamp_millis(millis), "dd MMM yyyy"), F.lit("+"))


def spoken(name: Column, percent: Column, advice: Column) -> Column:
    """Text to read aloud; advice only where there is any."""
    return F.concat_ws(" ", F.concat(name, F.lit(".")), F.format_string("Confidence %.0f percent.", percent), F.when(F.length(advice) > 0, advice))


def every_nth(values: Column, n: int = 8) -> Column:
    return F.filter(values, lambda x, i: i % n == 0)


def mean_of_first(values: Column, n: int = 8) -> Column:
    first = F.slice(values, 1, n)
    return F.try_divide(F.aggregate(first, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(first))
