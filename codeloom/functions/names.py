"""Column functions over names, ids, paths and reference texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dump folder -> kind of the objects in it.
SECTIONS = {
    "Catalogs": "Catalog", "Documents": "Document", "DocumentJournals": "DocumentJournal", "Enums": "Enum", "Constants": "Constant",
    "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister", "AccountingRegisters": "AccountingRegister",
    "CalculationRegisters": "CalculationRegister", "BusinessProcesses": "BusinessProcess", "Tasks": "Task", "ChartsOfAccounts": "ChartOfAccounts",
    "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "ChartsOfCalculationTypes": "ChartOfCalculationTypes", "ExchangePlans": "ExchangePlan",
    "Sequences": "Sequence", "DataProcessors": "DataProcessor", "Reports": "Report", "CommonModules": "CommonModule", "CommonForms": "CommonForm",
    "CommonCommands": "CommonCommand", "CommonTemplates": "CommonTemplate", "CommonPictures": "CommonPicture", "CommonAttributes": "CommonAttribute",
    "CommandGroups": "CommandGroup", "Subsystems": "Subsystem", "Roles": "Role", "Languages": "Language", "Styles": "Style", "StyleItems": "StyleItem",
    "FilterCriteria": "FilterCriterion", "DefinedTypes": "DefinedType", "FunctionalOptions": "FunctionalOption",
    "FunctionalOptionsParameters": "FunctionalOptionsParameter", "EventSubscriptions": "EventSubscription", "ScheduledJobs": "ScheduledJob",
    "SessionParameters": "SessionParameter", "SettingsStorages": "SettingsStorage", "HTTPServices": "HTTPService", "WebServices": "WebService",
    "WSReferences": "WSReference", "XDTOPackages": "XDTOPackage", "ExternalDataSources": "ExternalDataSource", "IntegrationServices": "IntegrationService",
    "Forms": "Form", "Templates": "Template", "Commands": "Command", "Attributes": "Attribute", "TabularSections": "TabularSection",
}
# Name of a collection in module code -> kind.
COLLECTIONS = {
    "Справочники": "Catalog", "Документы": "Document", "ЖурналыДокументов": "DocumentJournal", "Перечисления": "Enum", "Константы": "Constant",
    "РегистрыСведений": "InformationRegister", "РегистрыНакопления": "AccumulationRegister", "РегистрыБухгалтерии": "AccountingRegister",
    "РегистрыРасчета": "CalculationRegister", "БизнесПроцессы": "BusinessProcess", "Задачи": "Task", "ПланыСчетов": "ChartOfAccounts",
    "ПланыВидовХарактеристик": "ChartOfCharacteristicTypes", "ПланыВидовРасчета": "ChartOfCalculationTypes", "ПланыОбмена": "ExchangePlan",
    "Последовательности": "Sequence", "Обработки": "DataProcessor", "Отчеты": "Report", "ОбщиеМодули": "CommonModule", "ОбщиеФормы": "CommonForm",
    "ОбщиеКоманды": "CommonCommand", "ОбщиеМакеты": "CommonTemplate", "Подсистемы": "Subsystem", "Роли": "Role",
    "ПодпискиНаСобытия": "EventSubscription", "РегламентныеЗадания": "ScheduledJob", "ПараметрыСеанса": "SessionParameter", "Метаданные": "Metadata",
}
# Name of a table of the query language -> kind.
QUERY_TABLES = {
    "Справочник": "Catalog", "Документ": "Document", "ЖурналДокументов": "DocumentJournal", "Перечисление": "Enum", "Константа": "Constant",
    "РегистрСведений": "InformationRegister", "РегистрНакопления": "AccumulationRegister", "РегистрБухгалтерии": "AccountingRegister",
    "РегистрРасчета": "CalculationRegister", "БизнесПроцесс": "BusinessProcess", "Задача": "Task", "ПланСчетов": "ChartOfAccounts",
    "ПланВидовХарактеристик": "ChartOfCharacteristicTypes", "ПланВидовРасчета": "ChartOfCalculationTypes", "ПланОбмена": "ExchangePlan",
}
# Event name in metadata -> name of its handler in code.
EVENTS = {
    "BeforeWrite": "ПередЗаписью", "AfterWrite": "ПослеЗаписи", "OnCopy": "ПриКопировании", "BeforeDelete": "ПередУдалением",
    "Filling": "ОбработкаЗаполнения", "FillCheck": "ОбработкаПроверкиЗаполнения", "Posting": "ОбработкаПроведения",
    "UndoPosting": "ОбработкаУдаленияПроведения", "OnSetNewCode": "ПриУстановкеНовогоКода", "OnSetNewNumber": "ПриУстановкеНовогоНомера",
    "OnOpen": "ПриОткрытии", "OnClose": "ПриЗакрытии", "OnCreateAtServer": "ПриСозданииНаСервере", "OnChange": "ПриИзменении",
    "ChoiceProcessing": "ОбработкаВыбора",
}
# Sections of a metadata card, reference contexts from frequent to rare.
CARD_SECTIONS = ("Attribute", "TabularSection", "Form", "Command", "Template", "Dimension", "Resource", "EnumValue", "Parameter")
CONTEXTS = ("code", "query", "type", "content", "field", "form", "template", "command", "event", "right", "other")
# What follows a kind's name in the type prefixes of references.
TYPE_SUFFIXES = ("", "Ref", "Object", "Selection", "List", "Manager", "RecordSet", "RecordKey", "RecordManager", "ValueManager")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def mapped(pairs: dict[str, str], key: Column, fold: bool = True) -> Column:
    """Value of a small fixed map; ``fold`` compares without case. Null where there is none."""
    table = {k.lower(): v for k, v in pairs.items()} if fold else pairs
    return F.try_element_at(literal_map(table), F.lower(key) if fold else key)


def kind_of_section(path: str | Column) -> Column:
    return mapped(SECTIONS, F.split_part(_c(path), F.lit("/"), F.lit(1)))


def kind_of_type_prefix(prefix: Column) -> Column:
    kinds = sorted({k for k in SECTIONS.values()})
    return mapped({k + s: k for k in kinds for s in TYPE_SUFFIXES}, prefix)


def reference(text: str | Column) -> Column:
    """``[ns:]Prefix.Name[.rest]`` as ``struct<kind, name, rest>``; null where the prefix is unknown or a name is missing."""
    bare = F.regexp_replace(F.trim(_c(text)), r"^[^.:]*:", "")
    kind = kind_of_type_prefix(F.split_part(bare, F.lit("."), F.lit(1)))
    name = F.split_part(bare, F.lit("."), F.lit(2))
    rest = F.nullif(F.regexp_replace(bare, r"^[^.]*\.[^.]*\.?", ""), F.lit(""))
    return F.when(kind.isNotNull() & (name != ""), F.struct(kind.alias("kind"), name.alias("name"), rest.alias("rest")))


def id_kind(id_: str | Column) -> Column:
    """Kind of ``Kind.Name``; empty where there is no dot."""
    return F.when(_c(id_).contains("."), F.substring_index(_c(id_), ".", 1)).otherwise("")


def id_name(id_: str | Column) -> Column:
    return F.when(_c(id_).contains("."), F.regexp_replace(_c(id_), r"^[^.]*\.", "")).otherwise(_c(id_))


def top_level_id(id_: str | Column) -> Column:
    return F.substring_index(_c(id_), "/", 1)


def call_name(callee: str | Column) -> Column:
    """Last segment of a call, lower-cased."""
    return F.lower(F.substring_index(_c(callee), ".", -1))


def routine_id(path: str | Column, name: str | Column) -> Column:
    return F.concat(F.lit("routine:module:"), _c(path), F.lit("#"), _c(name))


def context_kind(context: str | Column) -> Column:
    return F.when(_c(context).isin("code", "query"), "UsesMetadata").otherwise("References")


def event_name(name: str | Column) -> Column:
    return mapped(EVENTS, _c(name))


def module_kind(path: str | Column) -> Column:
    """Kind of a module from its file name, folder and section."""
    p = _c(path)
    base, folder = F.substring_index(p, "/", -1), F.regexp_replace(p, "/?[^/]*$", "")
    named = ["ObjectModule", "ManagerModule", "RecordSetModule", "ValueManagerModule", "CommandModule", "FormModule", "ManagedApplicationModule", "SessionModule", "ExternalConnectionModule", "OrdinaryApplicationModule"]
    out = F.when(base.isin(*[f"{n}.bsl" for n in named]), F.regexp_replace(base, r"\.bsl$", ""))
    plain = base == "Module.bsl"
    out = out.when(plain & F.lower(folder).endswith("/ext/form"), "FormModule")
    for section, kind in (("CommonModules", "CommonModule"), ("HTTPServices", "HTTPServiceModule"), ("WebServices", "WebServiceModule"), ("IntegrationServices", "IntegrationServiceModule")):
        out = out.when(plain & (F.split_part(p, F.lit("/"), F.lit(1)) == section), kind)
    return out.otherwise("Unknown")


def module_display(path: str | Column) -> Column:
    """The segment before the first ``Ext``; the file name where there is none."""
    parts = F.split(_c(path), "/")
    at = F.array_position(parts, "Ext")
    return F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise(F.element_at(parts, -1))


def topic_name(path: str | Column) -> Column:
    """``a/b.html`` as ``a.b``."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.trim(_c(path)), r"(?i)\.html?$", ""), "/\\", ".."), r"^\.+|\.+$", "")


def rights_detail(rights: str | Column, has_rls: str | Column) -> Column:
    """``Read=true;Insert=false;RLS`` from a map of rights in key order."""
    items = F.transform(F.array_sort(F.map_entries(_c(rights))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.concat(items, F.when(_c(has_rls), F.array(F.lit("RLS"))).otherwise(F.expr("cast(array() as array<string>)"))), ";")


def parse_rights(detail: str | Column) -> Column:
    """``struct<rights map<string,boolean>, has_rls>`` of a rights detail; other flags are left out."""
    parts = F.filter(F.split(_c(detail), ";"), lambda x: x.rlike("^[^=]+=(true|false)$"))
    pairs = F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), (F.split_part(x, F.lit("="), F.lit(2)) == "true").alias("value")))
    return F.struct(F.map_from_entries(pairs).alias("rights"), F.array_contains(F.split(_c(detail), ";"), "RLS").alias("has_rls"))


def properties_json(properties: str | Column, most: int = 40) -> Column:
    """JSON of the first ``most`` non-blank properties in key order; null if none is left."""
    kept = F.slice(F.array_sort(F.map_entries(F.map_filter(_c(properties), lambda k, v: v.isNotNull() & (F.trim(v) != "")))), 1, most)
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept)))


def place_line(place: str | Column) -> Column:
    """Line number of ``{Module.Path(12,3)}`` or ``... Строка: 12``; null where there is none."""
    found = F.regexp_extract(_c(place), r"(?i)(?:\(|строка[ -:]*|line[ :]*)(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def place_module(place: str | Column) -> Column:
    """Name of the module in ``{Module.Path(12,3)}``; null where there is none."""
    return F.nullif(F.regexp_extract(_c(place), r"\{([^{}()]+)\(\d+", 1), F.lit(""))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
