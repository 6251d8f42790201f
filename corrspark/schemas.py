"""Explicit schemas of the feeds and of the tables built from them."""

# One yearly vulnerability feed file (multi-line JSON).
CVSS_V2 = """struct<cvssV2: struct<vectorString: string, accessVector: string, accessComplexity: string,
    authentication: string, confidentialityImpact: string, integrityImpact: string,
    availabilityImpact: string, baseScore: double>>"""
CVSS_V3 = """struct<cvssV3: struct<vectorString: string, attackVector: string, attackComplexity: string,
    privilegesRequired: string, userInteraction: string, scope: string, confidentialityImpact: string,
    integrityImpact: string, availabilityImpact: string, baseSeverity: string, baseScore: double>>"""
LANG_VALUES = "array<struct<lang: string, value: string>>"
CVE_ITEM = f"""struct<
    cve: struct<
        CVE_data_meta: struct<ID: string, ASSIGNER: string>,
        description: struct<description_data: {LANG_VALUES}>,
        references: struct<reference_data: array<struct<url: string, name: string, refsource: string, tags: array<string>>>>,
        problemtype: struct<problemtype_data: array<struct<description: {LANG_VALUES}>>>>,
    impact: struct<baseMetricV2: {CVSS_V2}, baseMetricV3: {CVSS_V3}>,
    configurations: struct<nodes: array<struct<cpe_match: array<struct<vulnerable: boolean, cpe23Uri: string>>>>>,
    publishedDate: string,
    lastModifiedDate: string>"""
CVE_FEED = f"""CVE_data_timestamp string, CVE_data_type string, CVE_data_format string,
    CVE_data_version string, CVE_Items array<{CVE_ITEM}>"""

# Catalogue headers: attributes of the root element only.
CATALOGUE_HEADER = "_Name string, _Version string, _Date string"

# Attack patterns. Elements with mixed content are read as strings, which keeps
# their inner markup in order; see functions.text.inner_text.
CAPEC_TEXT = """_ID string, _Name string, _Abstraction string, _Status string,
    Description string, Extended_Description string, Likelihood_Of_Attack string, Typical_Severity string,
    Prerequisites struct<Prerequisite: array<string>>,
    Skills_Required struct<Skill: array<string>>,
    Resources_Required struct<Resource: array<string>>,
    Indicators struct<Indicator: array<string>>,
    Alternate_Terms struct<Alternate_Term: array<struct<Term: string>>>,
    Consequences struct<Consequence: array<struct<Scope: array<string>, Impact: array<string>, Note: string>>>,
    Mitigations struct<Mitigation: array<string>>,
    Example_Instances struct<Example: array<string>>,
    Execution_Flow struct<Attack_Step: array<struct<Step: string, Phase: string, Description: string, Technique: array<string>>>>,
    Related_Attack_Patterns struct<Related_Attack_Pattern: array<struct<_CAPEC_ID: string, _Nature: string>>>"""
# Attributes of elements whose text is read above.
CAPEC_ATTRIBUTES = "_ID string, Skills_Required struct<Skill: array<struct<_Level: string>>>"

CWE_TEXT = """_ID string, _Name string, _Abstraction string, _Structure string, _Status string,
    Description string, Extended_Description string, Likelihood_Of_Exploit string,
    Background_Details struct<Background_Detail: array<string>>,
    Functional_Areas struct<Functional_Area: array<string>>,
    Common_Consequences struct<Consequence: array<struct<Scope: array<string>, Impact: array<string>, Note: string>>>,
    Applicable_Platforms struct<
        Language: array<struct<_Class: string, _Name: string, _Prevalence: string>>,
        Operating_System: array<struct<_Class: string, _Name: string, _Prevalence: string>>,
        Architecture: array<struct<_Class: string, _Name: string, _Prevalence: string>>,
        Technology: array<struct<_Class: string, _Name: string, _Prevalence: string>>>,
    Potential_Mitigations struct<Mitigation: array<struct<Phase: array<string>, Strategy: array<string>, Description: string, Effectiveness: string>>>,
    Detection_Methods struct<Detection_Method: array<struct<_Detection_Method_ID: string, Method: string, Description: string, Effectiveness: string>>>,
    Observed_Examples struct<Observed_Example: array<struct<Reference: string, Description: string>>>,
    Demonstrative_Examples struct<Demonstrative_Example: array<struct<Intro_Text: string, Body_Text: array<string>, Example_Code: array<string>>>>,
    Alternate_Terms struct<Alternate_Term: array<struct<Term: string, Description: string>>>,
    Modes_Of_Introduction struct<Introduction: array<struct<Phase: array<string>, Note: string>>>,
    Related_Weaknesses struct<Related_Weakness: array<struct<_Nature: string, _CWE_ID: string, _View_ID: string>>>,
    Related_Attack_Patterns struct<Related_Attack_Pattern: array<struct<_CAPEC_ID: string>>>"""
CWE_ATTRIBUTES = """_ID string,
    Demonstrative_Examples struct<Demonstrative_Example: array<struct<Example_Code: array<struct<_Nature: string, _Language: string>>>>>"""

# Platform element names, in catalogue order.
PLATFORM_TYPES = ("Language", "Operating_System", "Architecture", "Technology")

# Ground truth file: one array of these.
TRUTH = "CVE_ID string, Assigned_CAPEC_ID array<string>"

# Correlation requests and results.
REQUEST = "task_id string, cve_id string, host string"
CORRELATION = "task_id string, cve_id string, model string, capec_id string, final_score double, rank int"
DATA_UPDATE = """name string, last_update timestamp, next_scheduled_update timestamp, has_been_updated boolean,
    update_frequency int, version string, status string"""
