"""Labels inferred from feature names by ordered decision lists; the first match wins, so order is meaning.

A decision looks at three forms of a name: as written, in capitals, and compact (capitals, other runs as one underscore).
Lists are data and compile into one `when` chain, so a table of names is labelled in one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decision:
    """Holds if some word is a token of the compact form, or a part occurs in it, or a letter string in the capitals, or a text in the name; not if unless occurs in the capitals."""

    label: str
    words: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    letters: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    unless: str = ""

    def column(self, name: Column) -> Column:
        capitals = F.upper(name)
        compact = F.regexp_replace(capitals, "[^A-Z0-9]+", "_")
        tests = []
        if self.words:
            tests.append(compact.rlike(f"(^|_)({'|'.join(self.words)})(_|$)"))
        for form, found in ((compact, self.parts), (capitals, self.letters), (name, self.texts)):
            if found:
                tests.append(form.rlike("|".join(map(re.escape, found))))
        holds = reduce(lambda a, b: a | b, tests)
        return holds & ~capitals.contains(self.unless) if self.unless else holds


def classify(name: Column, decisions: tuple[Decision, ...], otherwise: Column | str) -> Column:
    chain = reduce(lambda c, d: c.when(d.column(name), d.label), decisions, F.when(F.lit(False), ""))
    return chain.otherwise(otherwise)


_AGE = Decision("age", ("AGE", "ALTER1", "ALTERG"), ("AGE_YEARS", "FEATURE_AGE", "YEARS_OLD"), (), ("年龄", "老年", "青壮年", "未成年"))

# Decision lists and their word lists.
FAMILY = (
    Decision("vehicle_mass", parts=("GEWGES",), texts=("碰撞时的总重",)),
    Decision("vehicle_state", ("USAGE",), ("VEHUSAGE",), texts=("车辆用途",)),
    Decision("speed_v0", parts=("INITIAL_SPEED", "PRECRASH_SPEED", "TRAVEL_SPEED", "SPEED_V0", "V_INIT")),
    Decision("speed_vk", parts=("COLLISION_SPEED", "IMPACT_SPEED", "CRASH_SPEED", "SPEED_VK", "DELTA_V")),
    _AGE,
    Decision("bio", parts=("GESCHL", "GENDER", "SEX", "HEIGHT", "WEIGHT", "BMI", "GROESP", "GEWP")),
    Decision("road_surface", parts=("FRICTION", "SURFACE", "PAVEMENT", "MUE", "MU_")),
    Decision("light", parts=("LIGHT", "LIGHTING", "DAYLIGHT", "DARK", "NIGHT", "DUSK", "DAWN", "LICHT")),
    Decision("road_type", parts=("ROAD_TYPE", "ROAD_CLASS", "STRART", "URBAN", "RURAL", "HIGHWAY")),
    Decision("road_env", parts=("INTERSECTION", "JUNCTION", "CROSSING", "ROAD_ENV", "ROAD_SECTION")),
    Decision("lane", parts=("LANE", "SPUR", "SHOULDER", "MEDIAN")),
    Decision("vehicle_state", parts=("POWERTRAIN", "ENGINE_TYPE", "FUEL", "NEV", "ELECTRIC", "HYBRID")),
    Decision("weather", parts=("WEATHER", "WETTER", "RAIN", "SNOW", "FOG", "WIND", "VISIBILITY")),
    Decision("vehicle_size", parts=("VEHICLE_WIDTH", "VEHICLE_HEIGHT", "VEHICLE_LENGTH", "BREITE", "HOEHE", "LAENGE")),
    Decision("safety", ("AEB", "ABS", "ESC", "ASR", "ESP"), ("AIRBAG", "SEATBELT", "BELT", "SAFETY", "ASSIST")),
    Decision("crash_type", parts=("CRASH_TYPE", "COLLISION_TYPE", "IMPACT_POINT", "STOSS", "CONFLICT_TYPE")),
    Decision("speed_v0", letters=("V0",), texts=("初始速度",)),
    Decision("speed_vk", letters=("VK",), unless="VKREG"),
    Decision("speed_vk", texts=("碰撞速度",)),
    Decision("bio", texts=("体重", "身高")),
    Decision("road_surface", texts=("附着", "路面")),
    Decision("light", texts=("路灯", "照明", "夜")),
    Decision("road_type", texts=("道路类型", "公路", "城市道路")),
    Decision("road_env", texts=("普通路段", "交叉", "路段")),
    Decision("lane", texts=("车道",)),
    Decision("weather", texts=("天气", "雨", "雪")),
    Decision("vehicle_size", texts=("车宽", "车高", "车长")),
    Decision("safety", letters=("AEB",), texts=("安全",)),
    Decision("crash_type", texts=("碰撞", "冲突", "事故类型")),
    Decision("engineering", letters=("ENGINE",), texts=("工程",)),
    Decision("vehicle_state", texts=("车辆状态", "行驶状态", "制动")),
)
MISSING = (
    Decision("partial_unknown_detail", letters=("YES_BUT_UNKNOWN_DETAIL", "PARTIAL_UNKNOWN_DETAIL"), texts=("有_具体未知", "存在_具体未知")),
    Decision("pure_missing_unknown", parts=("MISSING_OR_UNKNOWN",), letters=("UNKNOWN", "MISSING", "N/A"), texts=("未知", "不详", "缺失", "未记录", "未填", "无资料", "不适用")),
)
SOURCE = tuple(
    Decision(label, words)
    for label, words in (
        ("ALTERG", ("ALTERG",)), ("GEWGES", ("GEWGES",)), ("事故类型_UTYP", ("UTYP",)), ("STFUHO", ("STFUHO",)), ("STRART", ("STRART",)), ("STRKL", ("STRKL",)), ("ACSCE", ("ACSCE",)),
        ("URSWIS", ("URSWIS[123]?",)), ("MARK", ("MARK",)), ("BSPUR", ("BSPUR",)), ("SPURZ", ("SPURZ",)), ("GESCHL", ("GESCHL",)), ("VEHUSAGE", ("VEHUSAGE",)),
        ("FEATURE_Opp_Powertrain", ("FEATURE_OPP_POWERTRAIN",)), ("FEATURE_Age_Group", ("FEATURE_AGE_GROUP",)), ("BLICHT", ("BLICHT",)), ("STROB", ("STROB",)), ("WINDV", ("WINDV",)),
        *((k, (k,)) for k in ("V0", "VK", "LAENGE", "BREITE", "HOEHE", "GEWP", "GEWPG", "GROESP", "GROESPG", "ALTER1", "PTYPE", "MUE", "BRPX", "BRPY", "BRPZ", "STOSSPX", "STOSSPY", "STOSSPZ")),
    )
)
SEMANTIC = (
    Decision("age_over60", parts=("FEATURE_AGE_OVER60", "FEATURE_AGE_GROUP_"), texts=("老年_60",)),
    Decision("age_elderly_group", ("ALTERG_?11",), texts=("71岁以上", "60岁以上")),
    Decision("age_group", ("ALTERG",)),
    Decision("raw_age_continuous", ("ALTER1", "AGE_YEARS")),
    Decision("precrash_speed", ("V0",)),
    Decision("impact_speed", ("VK",), unless="VKREG"),
    Decision("weight_body_size", ("GEWP",), ("GEWPG",), texts=("体重",)),
    Decision("height_body_size", parts=("GROESP",), texts=("身高",)),
    Decision("vehicle_mass", parts=("GEWGES",), texts=("碰撞时的总重",)),
    Decision("vehicle_geometry_length", parts=("LAENGE", "LANGE"), texts=("车长",)),
    Decision("vehicle_geometry_height", parts=("HOEHE",), texts=("车高",)),
    Decision("vehicle_geometry_width", parts=("BREITE",), texts=("车宽",)),
    Decision("crash_contact_geometry", parts=("BRPX", "BRPY", "BRPZ", "STOSSPX", "STOSSPY", "STOSSPZ"), texts=("第一碰撞点", "碰撞点坐标")),
    Decision("crash_configuration_type", parts=("UTYP",), texts=("事故类型",)),
    Decision("road_environment_type", parts=("STFUHO",), texts=("道路环境",)),
    Decision("road_surface", parts=("STROB",), texts=("路面情况",)),
    Decision("lighting_visibility", parts=("BLICHT", "LICHT"), texts=("路灯", "照明", "夜间")),
    Decision("weather_wind", parts=("WINDV",), texts=("天气", "风", "雨", "雪", "雾")),
    Decision("safety_assistance", parts=("ACSCE", "AEB", "LKA", "COLLWARN", "SPURHAE"), texts=("车道保持", "碰撞预警", "主动安全")),
    Decision("sex", parts=("GESCHL",), texts=("性别",)),
    Decision("person_type", parts=("PTYPE",), texts=("人员类型",)),
)
THRESHOLD = (
    Decision("domain_age_60", letters=("FEATURE_AGE", "ALTER"), texts=("年龄",)),
    Decision("domain_speed_50", letters=("V0",), texts=("初始速度",)),
    Decision("domain_speed_50", letters=("VK",), unless="VKREG"),
    Decision("domain_speed_50", texts=("碰撞速度",)),
    Decision("domain_friction_0_5", letters=("MUE",), texts=("附着",)),
    Decision("train_median_height", letters=("GROESP",), texts=("身高",)),
    Decision("train_median_weight", letters=("GEWP",), texts=("体重",)),
    Decision("train_median_vehicle_mass", letters=("GEWGES",), texts=("碰撞时的总重",)),
    Decision("train_median_vehicle_size", letters=("HOEHE", "BREITE"), texts=("车高", "车宽", "车长")),
    Decision("train_median_collision_geometry", letters=("STOSS",), texts=("角",)),
)
DOMAIN_THRESHOLDS = {"domain_age_60": (60.0, ">"), "domain_speed_50": (50.0, ">"), "domain_friction_0_5": (0.5, "<=")}


def family(name: Column) -> Column:
    return classify(name, FAMILY, "other")


def missing_category(name: Column) -> Column:
    in_parts = name.contains("具体未知") & name.rlike("有|存在")
    return F.when(in_parts, "partial_unknown_detail").otherwise(classify(name, MISSING, "not_missing_category"))


def source_group(name: Column) -> Column:
    """The coded variable a feature comes from; else its name without the last of three or more parts."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    rest = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), "_")).otherwise(name)
    return F.when(name == "FEATURE_Age_Over60", name).otherwise(classify(name, SOURCE, rest))


def semantic_group(name: Column) -> Column:
    unknown = missing_category(name) == "pure_missing_unknown"
    return F.when(unknown, "unknown_missing_category").otherwise(classify(name, SEMANTIC, F.concat(F.lit("other_unique:"), source_group(name))))


def compact(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def is_raw_age(name: Column) -> Column:
    """Whether a feature is an age in years, not a group of ages."""
    return compact(name).rlike("(^|_)(ALTER1|AGE_YEARS)$")


def is_age_related(name: Column) -> Column:
    """Whether a feature speaks of age in any form; a vehicle's usage does not."""
    usage = Decision("", ("USAGE",), ("VEHUSAGE",))
    return ~usage.column(name) & _AGE.column(name)


def threshold_source(name: Column) -> Column:
    return classify(name, THRESHOLD, "train_median_exploratory")


# Mechanism axes in order, by the traits that a rule's families and names must have and must not have.
AXES = (
    ("speed_energy", ("v0", "vk"), ()),
    ("vehicle_mass_speed_energy", ("speed", "mass"), ()),
    ("vehicle_geometry_vulnerability", ("geometry", "age"), ()),
    ("vulnerability_speed", ("speed", "age"), ()),
    ("vulnerability_demographic_speed", ("speed", "sex"), ("body",)),
    ("vulnerability_demographic", ("age", "sex"), ("body",)),
    ("vulnerability_body", ("body",), ()),
    ("road_speed_environment", ("road", "speed"), ()),
    ("vehicle_geometry_interaction", ("geometry",), ()),
    ("vehicle_mass_speed_energy", ("mass",), ()),
    ("lighting_visibility", ("light",), ()),
    ("surface_weather_friction", ("surface",), ()),
    ("safety_assistance", ("safety",), ()),
    ("crash_configuration", ("crash",), ()),
    ("speed_energy", ("speed",), ()),
)
TRAITS = {
    "v0": (("speed_v0",), ("V0", "INITIAL_SPEED")),
    "vk": (("speed_vk",), ("VK", "IMPACT_SPEED", "COLLISION_SPEED")),
    "age": (("age",), ("FEATURE_AGE", "AGE_YEARS", "ALTER1", "ALTERG", "年龄", "老年", "青壮年", "未成年")),
    "mass": (("vehicle_mass",), ("GEWGES", "碰撞时的总重")),
    "body": ((), ("GEWP", "GROESP", "WEIGHT", "HEIGHT", "BMI", "体重", "身高")),
    "sex": ((), ("GESCHL", "GENDER", "性别")),
    "road": (("road_env", "road_type", "lane"), ("ROAD_ENV", "ROAD_TYPE", "LANE", "STRART", "SPUR", "交叉", "路段", "车道")),
    "geometry": (("vehicle_size", "vehicle_state"), ("VEHICLE_WIDTH", "VEHICLE_HEIGHT", "VEHICLE_LENGTH", "BREITE", "HOEHE", "LAENGE", "车辆用途", "车高", "车宽", "车长")),
    "light": (("light",), ("LIGHT", "NIGHT", "LICHT", "STRABEL", "照明", "路灯", "夜")),
    "surface": (("road_surface", "weather"), ("MUE", "FRICTION", "SURFACE", "WEATHER", "WIND", "RAIN", "SNOW", "FOG", "雨", "雪", "雾", "路面")),
    "safety": (("safety",), ("SAFETY", "AEB", "LKA", "SPURHAE", "ASSIST", "车道保持", "主动安全")),
    "crash": (("crash_type",), ("CRASH_TYPE", "STOSS", "COLLISION_TYPE", "IMPACT_POINT", "碰撞角", "事故类型")),
}
# The scene of governance of each axis.
SCENES = {
    "speed_energy": "speed enforcement and conflict-speed management",
    "vulnerability_speed": "VRU vulnerability-sensitive speed and crossing protection",
    "vulnerability_body": "injury susceptibility stratification",
    "vulnerability_demographic": "individual demographic risk stratification",
    "vulnerability_demographic_speed": "demographic speed-risk stratification",
    "road_speed_environment": "road-space, intersection, and lane organization governance",
    "vehicle_geometry_interaction": "vehicle geometry, blind-zone, and VRU protection design",
    "vehicle_geometry_vulnerability": "vehicle geometry and vulnerability stratification",
    "vehicle_mass_speed_energy": "vehicle mass-speed energy audit signal",
    "lighting_visibility": "night lighting and visibility governance",
    "surface_weather_friction": "low-friction road surface and weather governance",
    "safety_assistance": "vehicle active safety configuration governance",
    "crash_configuration": "conflict type and road-space redesign governance",
    "mixed_multimechanism": "cross-mechanism audit and hypothesis governance",
}


def mechanism_axis(families: Column, names: Column) -> Column:
    """Of a rule, from arrays of its items' families and feature names."""
    text = F.upper(F.array_join(names, " "))
    trait = {}
    for key, (own, words) in TRAITS.items():
        by_family = F.arrays_overlap(families, F.array(*map(F.lit, own))) if own else F.lit(False)
        trait[key] = F.coalesce(by_family, F.lit(False)) | text.rlike("|".join(map(re.escape, words)))
    # a token of its own, where USAGE has been taken out
    trait["age"] = trait["age"] | F.regexp_replace(text, r"(^|_)USAGE(_|$)", " ").rlike(r"(^|_)AGE(_|$)")
    trait["sex"] = trait["sex"] | text.rlike(r"(^|[_ ])SEX([_ ]|$)")
    trait["speed"] = trait["v0"] | trait["vk"]
    chain = F.when(F.lit(False), "")
    for label, needs, lacks in AXES:
        chain = chain.when(reduce(lambda a, b: a & b, [*(trait[t] for t in needs), *(~trait[t] for t in lacks)]), label)
    return chain.otherwise("mixed_multimechanism")


# What an axis is suited for, and the domain of governance that it belongs to, in the order in which domains are reported.
TEMPLATES = {
    "speed_energy": "速度-碰撞能量轴线，适合支持限速、速度执法、冲突区速度管理和碰撞速度降低策略。",
    "vulnerability_speed": "易损个体-速度轴线，适合支持老年/体弱VRU高暴露场景下的速度控制、过街保护和预警设施。",
    "vulnerability_body": "个体脆弱性-体格轴线，适合作为伤害易感性分层线索，不应解释为可直接干预因果因素。",
    "vulnerability_demographic": "个体脆弱性—人口学分层轴线，适合作为年龄/性别等人群分层下的风险识别线索，不应解释为体格或可直接干预因素。",
    "vulnerability_demographic_speed": "个体脆弱性—人口学/速度分层轴线，适合作为速度暴露下的人群分层风险线索，不应解释为体格机制。",
    "road_speed_environment": "道路环境-速度轴线，适合支持普通路段、交叉口/路段过渡区、车道组织和VRU通行空间治理。",
    "vehicle_geometry_interaction": "车辆几何-VRU交互轴线，适合支持车辆前端几何、盲区、车辆类型和VRU保护设计讨论。",
    "vehicle_mass_speed_energy": "车辆总重—速度能量轴线，适合作为车辆质量/惯性与速度共同作用下的审计级治理线索。",
    "vehicle_geometry_vulnerability": "车辆几何—脆弱性分层轴线，适合作为车辆几何与VRU脆弱性共同出现的风险线索。",
    "lighting_visibility": "照明-可视性轴线，适合支持夜间照明、路灯状态、反光设施和主动警示治理。",
    "surface_weather_friction": "路面附着-天气轴线，适合支持湿滑/低附着道路、恶劣天气和路面维护治理。",
    "safety_assistance": "车辆安全配置轴线，适合支持AEB、LKA、VRU检测等车辆端主动安全配置讨论。",
    "crash_configuration": "碰撞构型轴线，适合支持冲突类型识别、交通组织和道路空间再设计。",
    "mixed_multimechanism": "多机制混合轴线，适合作为跨机制治理线索，需结合证据等级审慎解释。",
}
DOMAINS = {
    "speed_energy": "speed management and conflict-speed reduction",
    "vulnerability_speed": "vulnerable-user-sensitive crossing protection",
    "vulnerability_body": "injury susceptibility stratification",
    "vulnerability_demographic": "individual demographic risk stratification",
    "vulnerability_demographic_speed": "demographic speed-risk stratification",
    "road_speed_environment": "road-space and channelization governance",
    "vehicle_geometry_interaction": "vehicle geometry, blind-zone, and VRU protection design",
    "vehicle_mass_speed_energy": "vehicle mass-speed energy audit signal",
    "vehicle_geometry_vulnerability": "vehicle geometry and vulnerability stratification",
    "lighting_visibility": "lighting and visibility governance",
    "surface_weather_friction": "low-friction surface and adverse-weather governance",
    "safety_assistance": "vehicle active-safety governance",
    "crash_configuration": "crash-configuration-specific prevention",
    "mixed_multimechanism": "cross-mechanism audit and case review",
}
# How far an axis may be read, where rules are mined and where evidence is summed up; the last of each is for all other axes.
DEMOGRAPHIC_BOUNDARIES = {
    "vulnerability_demographic": "Individual vulnerability–demographic stratification axis; use as a demographic risk-stratification cue rather than a directly intervenable body-size mechanism.",
    "vulnerability_demographic_speed": "Demographic speed-risk stratification signal; do not interpret sex or age strata as body-size mechanisms.",
    "vehicle_geometry_vulnerability": "Vehicle geometry and vulnerability stratification signal; do not interpret demographic strata as body-size mechanisms.",
}
MINING_BOUNDARIES = {
    "vehicle_mass_speed_energy": "Vehicle mass-speed energy axis; use as an audit-level signal for vehicle mass/inertia combined with speed exposure, not as crash configuration governance.",
    "vulnerability_body": "Train-only mechanism label; vulnerability/body-size patterns are stratification signals, not directly intervenable causal factors.",
    "mixed_multimechanism": "Train-only mechanism label; use only with evidence tier and case-level replay context because no single mechanism dominates.",
    **DEMOGRAPHIC_BOUNDARIES,
    "": "Train-only mechanism label; interpret only together with fixed rule thresholds, blind replay results, and evidence tier.",
}
SUMMARY_BOUNDARIES = {
    "vehicle_mass_speed_energy": "Evidence summary only; vehicle mass/inertia combined with speed exposure is an audit-level signal, not crash configuration governance.",
    "vulnerability_body": "Evidence summary only; vulnerability/body-size patterns are stratification signals, not directly intervenable causal factors.",
    "mixed_multimechanism": "Evidence summary only; use with case-level replay context because no single mechanism dominates.",
    **DEMOGRAPHIC_BOUNDARIES,
    "": "Evidence summary only; does not modify selected features, rule universe, thresholds, sorting, or evidence tier.",
}


def _by_axis(axis: Column, values: dict[str, str], other: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, axis), F.lit(values[other]))


def scene(axis: Column) -> Column:
    return _by_axis(axis, SCENES, "mixed_multimechanism")


def axis_context(axis: Column) -> dict[str, Column]:
    """All that is said of a rule by its axis; axes that are unknown or null count as mixed, and have the boundary of all others."""
    place = F.array_position(F.lit(list(DOMAINS.values())), _by_axis(axis, DOMAINS, "mixed_multimechanism"))
    return {
        "scene": scene(axis),
        "template": _by_axis(axis, TEMPLATES, "mixed_multimechanism"),
        "mining_boundary": _by_axis(axis, MINING_BOUNDARIES, ""),
        "summary_boundary": _by_axis(axis, SUMMARY_BOUNDARIES, ""),
        "domain": _by_axis(axis, DOMAINS, "mixed_multimechanism"),
        "domain_place": place.cast("int"),
    }


# Semantic groups with a display form in two languages, and their unit.
DISPLAY = {
    "precrash_speed": ("Initial speed", "初始速度", " km/h"),
    "impact_speed": ("Impact speed", "碰撞速度", " km/h"),
    "vehicle_geometry_length": ("Vehicle length", "车辆长度", " mm"),
    "vehicle_geometry_height": ("Vehicle height", "车辆高度", " mm"),
    "vehicle_geometry_width": ("Vehicle width", "车辆宽度", " mm"),
    "vehicle_mass": ("Vehicle total weight", "车辆总重", ""),
}
PLAIN = {"age": ("Age > 60 years", "年龄 > 60岁"), "sex": ("Male", "男性")}
LANGUAGES = ("en", "zh")


def display_label(source: Column, item: Column, operator: Column, threshold: Column, language: str = "en") -> Column:
    """A readable form of an item; the item itself if there is none, or if it has a display form but no operator. Thresholds are written without trailing zeros."""
    at = LANGUAGES.index(language)
    semantic = semantic_group(source)
    male = F.upper(source).contains("GESCHL") & (source.contains("1-") | source.endswith("_1") | source.contains("男性"))
    number = F.regexp_replace(F.format_string("%f", threshold), r"\.?0+$", "")
    chain = F.when((source == "FEATURE_Age_Over60") | (semantic == "age_over60"), PLAIN["age"][at]).when(male, PLAIN["sex"][at])
    for group, form in DISPLAY.items():
        chain = chain.when((semantic == group) & operator.isNotNull(), F.concat(F.lit(f"{form[at]} "), operator, F.lit(" "), number, F.lit(form[2])))
    return chain.otherwise(item)


# What the families of a rule ask for, in order.
ACTIONS = (
    (("speed_v0", "speed_vk"), "speed management and conflict-speed reduction"),
    (("light",), "lighting or night-visibility treatment"),
    (("road_surface", "weather"), "surface-friction and adverse-weather countermeasures"),
    (("road_env", "road_type", "lane"), "road-space/channelization redesign"),
    (("vehicle_size", "safety"), "vehicle-geometry and active-safety intervention"),
    (("age", "bio"), "VRU vulnerability-sensitive protection"),
    (("crash_type",), "crash-configuration-specific prevention"),
)
NO_ACTION = "case review before policy use"


def interpretation(families: Column) -> Column:
    """The actions that a rule's families ask for, joined by semicolons."""
    each = [F.when(F.arrays_overlap(families, F.array(*map(F.lit, own))), action) for own, action in ACTIONS]
    joined = F.concat_ws("; ", *each)
    return F.when(joined == "", NO_ACTION).otherwise(joined)
