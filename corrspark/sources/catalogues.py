"""Weakness and attack-pattern catalogues: XML to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark import schemas
from corrspark.functions.text import collapse_or_null, inner_text


def read_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_header(spark: SparkSession, path: str, tag: str, name: str) -> DataFrame:
    """(name, version, date) of the catalogue; another catalogue name is an error."""
    head = read_rows(spark, path, tag, schemas.CATALOGUE_HEADER)
    checked = F.when(F.col("_Name") == name, F.col("_Name")).otherwise(
        F.raise_error(F.lit(f"the XML file is not a valid {name} catalogue"))
    )
    return head.select(checked.alias("name"), F.col("_Version").alias("version"), F.col("_Date").alias("date"))


def capec_header(spark: SparkSession, path: str) -> DataFrame:
    return read_header(spark, path, "Attack_Pattern_Catalog", "CAPEC")


def cwe_header(spark: SparkSession, path: str) -> DataFrame:
    return read_header(spark, path, "Weakness_Catalog", "CWE")


def _texts(col: Column) -> Column:
    """Cleaned inner text of each item; a missing list is empty."""
    return F.coalesce(F.transform(col, lambda x: inner_text(x)), F.array().cast("array<string>"))


def _plain(col: Column) -> Column:
    """Cleaned plain items, blank ones dropped; a missing list is empty."""
    kept = F.filter(col, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.transform(kept, collapse_or_null), F.array().cast("array<string>"))


def _scoped(consequences: Column) -> Column:
    return F.transform(
        consequences,
        lambda c: F.struct(_plain(c["Scope"]).alias("Scope"), _plain(c["Impact"]).alias("Impact"), inner_text(c["Note"]).alias("Note")),
    )


# --- attack patterns -------------------------------------------------------


def read_capec(spark: SparkSession, path: str) -> DataFrame:
    """Raw attack-pattern rows, skill levels joined to their texts."""
    rows = read_rows(spark, path, "Attack_Pattern", schemas.CAPEC_TEXT)
    levels = read_rows(spark, path, "Attack_Pattern", schemas.CAPEC_ATTRIBUTES)
    return rows.join(levels.select("_ID", F.col("Skills_Required.Skill").alias("skill_levels")), "_ID", "left")


def capec_records(raw: DataFrame) -> DataFrame:
    skills = F.transform(
        F.arrays_zip(F.col("skill_levels").alias("l"), F.col("Skills_Required.Skill").alias("t")),
        lambda z: F.struct(z["l"]["_Level"].alias("Level"), inner_text(z["t"]).alias("Description")),
    )
    terms = F.transform(F.col("Alternate_Terms.Alternate_Term"), lambda t: t["Term"])
    return raw.select(
        F.concat(F.lit("CAPEC-"), F.col("_ID")).alias("id"),
        F.col("_Name").alias("name"),
        F.col("_Abstraction").alias("abstraction"),
        F.col("_Status").alias("status"),
        inner_text(F.col("Description")).alias("description"),
        inner_text(F.col("Extended_Description")).alias("extended_description"),
        collapse_or_null(F.col("Likelihood_Of_Attack")).alias("likelihood_of_attack"),
        collapse_or_null(F.col("Typical_Severity")).alias("typical_severity"),
        _texts(F.col("Prerequisites.Prerequisite")).alias("prerequisites"),
        skills.alias("skills_required"),
        _texts(F.col("Resources_Required.Resource")).alias("resources_required"),
        _texts(F.col("Indicators.Indicator")).alias("indicators"),
        _texts(terms).alias("alternate_terms"),
        _scoped(F.col("Consequences.Consequence")).alias("consequences"),
        _texts(F.col("Mitigations.Mitigation")).alias("mitigations"),
        _texts(F.col("Example_Instances.Example")).alias("example_instances"),
        F.col("Execution_Flow").isNotNull().alias("has_execution_flow"),
    )


def capec_steps(raw: DataFrame) -> DataFrame:
    """Attack steps in document order; ``step`` is not yet unique, see number_steps."""
    exploded = raw.select(
        F.concat(F.lit("CAPEC-"), F.col("_ID")).alias("capec_id"),
        F.posexplode("Execution_Flow.Attack_Step").alias("pos", "s"),
    )
    return exploded.select(
        "capec_id",
        "pos",
        collapse_or_null(F.col("s.Step")).alias("step"),
        collapse_or_null(F.col("s.Phase")).alias("phase"),
        inner_text(F.col("s.Description")).alias("description"),
        _texts(F.col("s.Technique")).alias("techniques"),
    )


def capec_relations(raw: DataFrame) -> DataFrame:
    """(source, target, nature, pos) as listed; not yet checked or deduplicated."""
    exploded = raw.select(
        F.concat(F.lit("CAPEC-"), F.col("_ID")).alias("source"),
        F.posexplode("Related_Attack_Patterns.Related_Attack_Pattern").alias("pos", "r"),
    )
    target = F.concat(F.lit("CAPEC-"), F.col("r._CAPEC_ID"))
    return exploded.select("source", target.alias("target"), F.col("r._Nature").alias("nature"), "pos")


# --- weaknesses ------------------------------------------------------------


def read_cwe(spark: SparkSession, path: str) -> DataFrame:
    """Raw weakness rows, code attributes joined to their texts."""
    rows = read_rows(spark, path, "Weakness", schemas.CWE_TEXT)
    attrs = read_rows(spark, path, "Weakness", schemas.CWE_ATTRIBUTES)
    return rows.join(attrs.select("_ID", F.col("Demonstrative_Examples.Demonstrative_Example").alias("code_attrs")), "_ID", "left")


def cwe_records(raw: DataFrame) -> DataFrame:
    def platforms(kind: str) -> Column:
        listed = F.transform(
            F.col(f"Applicable_Platforms.{kind}"),
            lambda p: F.struct(
                F.lit(kind).alias("Type"), p["_Class"].alias("Class"), p["_Name"].alias("Name"), p["_Prevalence"].alias("Prevalence")
            ),
        )
        return F.coalesce(listed, F.array().cast("array<struct<Type: string, Class: string, Name: string, Prevalence: string>>"))

    mitigations = F.transform(
        F.col("Potential_Mitigations.Mitigation"),
        lambda m: F.struct(
            _plain(m["Phase"]).alias("Phase"),
            _plain(m["Strategy"]).alias("Strategy"),
            inner_text(m["Description"]).alias("Description"),
            collapse_or_null(m["Effectiveness"]).alias("Effectiveness"),
        ),
    )
    detection = F.transform(
        F.col("Detection_Methods.Detection_Method"),
        lambda m: F.struct(
            m["_Detection_Method_ID"].alias("detection_method_id"),
            inner_text(m["Description"]).alias("description"),
            collapse_or_null(m["Method"]).alias("method"),
            collapse_or_null(m["Effectiveness"]).alias("effectiveness"),
        ),
    )
    observed = F.transform(
        F.col("Observed_Examples.Observed_Example"),
        lambda e: F.struct(inner_text(e["Description"]).alias("description"), collapse_or_null(e["Reference"]).alias("cve_id")),
    )
    codes = lambda texts, attrs: F.transform(
        F.arrays_zip(texts.alias("t"), attrs.alias("a")),
        lambda z: F.struct(z["a"]["_Nature"].alias("Nature"), z["a"]["_Language"].alias("Language"), inner_text(z["t"]).alias("Content")),
    )
    demonstrations = F.transform(
        F.arrays_zip(F.col("Demonstrative_Examples.Demonstrative_Example").alias("e"), F.col("code_attrs").alias("a")),
        lambda z: F.struct(
            inner_text(z["e"]["Intro_Text"]).alias("Intro_Text"),
            _texts(z["e"]["Body_Text"]).alias("Body_Texts"),
            codes(z["e"]["Example_Code"], z["a"]["Example_Code"]).alias("Example_Codes"),
        ),
    )
    terms = F.transform(
        F.col("Alternate_Terms.Alternate_Term"),
        lambda t: F.struct(collapse_or_null(t["Term"]).alias("Term"), inner_text(t["Description"]).alias("Description")),
    )
    modes = F.transform(
        F.col("Modes_Of_Introduction.Introduction"),
        lambda m: F.struct(_plain(m["Phase"]).alias("Phase"), collapse_or_null(m["Note"]).alias("Note")),
    )
    return raw.select(
        F.concat(F.lit("CWE-"), F.col("_ID")).alias("id"),
        F.col("_Name").alias("name"),
        F.col("_Abstraction").alias("abstraction"),
        F.col("_Structure").alias("structure"),
        F.col("_Status").alias("status"),
        inner_text(F.col("Description")).alias("description"),
        inner_text(F.col("Extended_Description")).alias("extended_description"),
        collapse_or_null(F.col("Likelihood_Of_Exploit")).alias("likelihood_of_exploit"),
        _texts(F.col("Background_Details.Background_Detail")).alias("background_details"),
        _texts(F.col("Functional_Areas.Functional_Area")).alias("functional_areas"),
        _scoped(F.col("Common_Consequences.Consequence")).alias("common_consequences"),
        F.concat(*[platforms(k) for k in schemas.PLATFORM_TYPES]).alias("applicable_platforms"),
        mitigations.alias("potential_mitigations"),
        detection.alias("detection_methods"),
        observed.alias("observed_examples"),
        demonstrations.alias("demonstrative_examples"),
        terms.alias("alternate_terms"),
        modes.alias("modes_of_introduction"),
    )


def cwe_relations(raw: DataFrame) -> DataFrame:
    """(source, target, nature, view_id, pos) as listed."""
    exploded = raw.select(
        F.concat(F.lit("CWE-"), F.col("_ID")).alias("source"),
        F.posexplode("Related_Weaknesses.Related_Weakness").alias("pos", "r"),
    )
    return exploded.select(
        "source",
        F.concat(F.lit("CWE-"), F.col("r._CWE_ID")).alias("target"),
        F.col("r._Nature").alias("nature"),
        F.col("r._View_ID").alias("view_id"),
        "pos",
    )


def pattern_mentions(raw: DataFrame) -> DataFrame:
    """(cwe_id, capec_id) named by a weakness."""
    exploded = raw.select(
        F.concat(F.lit("CWE-"), F.col("_ID")).alias("cwe_id"),
        F.explode("Related_Attack_Patterns.Related_Attack_Pattern").alias("r"),
    )
    return exploded.select("cwe_id", F.concat(F.lit("CAPEC-"), F.col("r._CAPEC_ID")).alias("capec_id"))
