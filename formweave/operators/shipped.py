"""The shipped rule catalogue: nine forms, their keys and the rules between them.

A rule is a line ``name: expression``. Expressions over aliases:

* ``total = part + part``, ``product = factor * factor``: sums and products;
* ``left <= right``: numbers in order; ``earlier < later``: dates in order (the same day is);
* ``start .. end = years``: whole years between two dates.

What follows ``|`` sets a rule's other attributes (``severity=warning``, ``mutation_alias=lots``).
"""

from __future__ import annotations

import re
from functools import cache

from .rules import Catalogue, Rule

# Names of forms, keys of their documents, rules by name, tolerances and the operand a benchmark changes.
KEYS: dict[str, dict[str, str]] = {
    "eform1": {
        "report_date": "NgaythangnamzzValue",
        "certificate_date": "NgaycapGCNUBCKzzValue",
        "par_value": "MenhgiacophieuzzValue",
        "issued_shares": "TongsoluongcophieuphathanhzzValue",
        "total_raised": "TongsovondahuydongzzValue",
        "raised_amount": "SovondahuydongzzValue",
        "offering_end": "NgayketthucdotchaobanzzValue",
    },
    "eform100": {
        "document_date": "NgaytaogiayzzValue",
        "management_license_date": "NgaycapGPzzValue",
        "bank_license_date": "ngaycapGPTLnganhangzzValue",
        "custody_certificate_date": "ngaycapchungnhanluukyzzValue",
    },
    "eform5": {
        "report_date": "NgaytaobaocaozzValue",
        "latest_change": "NgaythaydoisoGCNgannhatzzValue",
        "charter_capital": "VondieulezzValue",
        "outstanding_shares": "TongsocophieudangluuhanhzzValue",
        "outstanding_value": "TonggiatricophieudangluuhanhzzValue",
        "par_value": "MenhgiacophieuzzValue",
        "offer_shares": "SoluongcophieudangkychaobanzzValue",
        "min_offer_price": "GiachaobanthapnhatdukienzzValue",
        "planned_raised": "TonggiatrivonhuydongdukienzzValue",
    },
    "eform69": {
        "document_date": "NgaytaogiayzzValue",
        "license_date": "NgaycapGPzzValue",
        "old_capital": "VondieulecuzzValue",
        "new_capital": "VondieulemoizzValue",
        "old_birth": "NgaysinhnguoidaidiencuzzValue",
        "old_id_date": "NgaycapCMNDHochieucuanguoidaidiencuzzValue",
        "new_birth": "NgaysinhnguoidaidienmoizzValue",
        "new_id_date": "NgaycapCMNDHochieucuanguoidaidienmoizzValue",
    },
    "eform7": {
        "report_date": "NgaybaocaozzValue",
        "certificate_change": "NgaythaydoiGCNTCPHzzValue",
        "par_value": "MenhgiatraiphieuzzValue",
        "offer_quantity": "SoluongtraiphieudangkychaobanzzValue",
        "offer_total": "TonggiatriTPchaobantheoMGzzValue",
        "secured_value": "GiatriTPduocbaodamzzValue",
        "guarantee_value": "GiatribaolanhzzValue",
        "collateral_value": "GiatritaisanbaodamzzValue",
        "outstanding_total": "TonggiatriTPluuhanhTongzzValue",
        "outstanding_public": "TonggiatriTPluuhanhCCzzValue",
        "outstanding_private": "TonggiatriTPluuhanhRLzzValue",
        "raised_total": "TonggiatriTPhuydong12thangTongzzValue",
        "raised_public": "TonggiatriTPhuydong12thangCCzzValue",
        "raised_private": "TonggiatriTPhuydong12thangRLzzValue",
    },
    "eform85": {
        "birth_date": "NgaythangnamsinhzzValue",
        "id_date": "NgaycapdinhdanhzzValue",
        "certificate_date": "NgaycapchungchihanhnghezzValue",
    },
    "eform92": {
        "license_date": "NgaycapGPzzValue",
        "offering_certificate_date": "NgaycapGCNdkychaobanzzValue",
        "charter_capital": "VondieulezzValue",
        "fund_units": "SoluongCCquyzzValue",
        "unit_par_value": "MenhgiaCCquyzzValue",
        "lots": "SoloCCquyzzValue",
        "units_per_lot": "SoCCquytrong1lozzValue",
    },
    "eform93": {
        "org_domestic": "SoluongnhadautuTochucTrongnuoczzText",
        "org_foreign": "SoluongnhadautuTochucNuocngoaizzText",
        "org_total": "SoluongnhadautuTochucTongzzText",
        "org_units_domestic": "SoluongchungchiquyTochucTrongnuoczzText",
        "org_units_foreign": "SoluongchungchiquyTochucNgoainuoczzText",
        "org_units_total": "SoluongchungchiquyTochucTongzzText",
        "org_ratio_domestic": "TylevongopTochucTrongnuoczzText",
        "org_ratio_foreign": "TylevongopTochucNgoainuoczzText",
        "org_ratio_total": "TylevongopTochucTongzzText",
        "individual_domestic": "SoluongnhadautuCanhanTrongnuoczzText",
        "individual_foreign": "SoluongnhadautuCanhanNuocngoaizzText",
        "individual_total": "SoluongnhadautuCanhanTongzzText",
        "individual_units_domestic": "SoluongchungchiquyCanhanTrongnuoczzText",
        "individual_units_foreign": "SoluongchungchiquyCanhanNgoainuoczzText",
        "individual_units_total": "SoluongchungchiquyCanhanTongzzText",
        "individual_ratio_domestic": "TylevongopCanhanTrongnuoczzText",
        "individual_ratio_foreign": "TylevongopCanhanNuocngoaizzText",
        "individual_ratio_total": "TylevongopCanhanTongzzText",
    },
    "eform94": {
        "document_date": "NgaytaogiayzzValue",
        "certificate_date": "NgaycapGCNDKlapquyzzValue",
        "duration_before": "SonamthoihantruockhithaydoizzValue",
        "old_start": "ThoihanhoatdongcutungayzzValue",
        "old_end": "ThoihanhoatdongcudenngayzzValue",
        "duration_after": "SonamthoihantruocsauthaydoizzValue",
        "new_end": "thoihanrutngandenngayzzValue",
        "old_capital": "VondieulequytruockhithaydoizzValue",
        "existing_units": "SLCCquycophandangluuhanhzzValue",
        "par_value": "MenhgiaCCquyzzValue",
        "additional_raised": "VonhuydongthemzzValue",
        "additional_units": "SLCCquycophanphathanhthemzzValue",
        "issue_price": "GiaphathanhcuamotCCquycophanzzValue",
        "post_capital": "VondieulequytruocsauthaydoizzValue",
        "post_units": "SLCCquycophanluuhanhsaukhithaydoizzValue",
        "acquired_capital": "VondieulecuacongtybisapnhapzzValue",
        "acquired_units": "SLCCquycophandangluuhanhcuacongtybisapnhapzzValue",
        "merged_capital": "VondieulecuacongtysaukhisapnhapzzValue",
        "merged_units": "SLCCquycophandangluuhanhtuviecsapnhapzzValue",
    },
}

RULES: dict[str, str] = {
    "eform1": """
        capital_product: total_raised = issued_shares * par_value
        raised_within_total: raised_amount <= total_raised | mutation_side=left
        offering_after_certificate: certificate_date < offering_end
        report_after_offering: offering_end < report_date
    """,
    "eform100": """
        document_after_management_license: management_license_date < document_date | mutation_alias=management_license_date
        document_after_bank_license: bank_license_date < document_date | eval_mutation=no
        document_after_custody_certificate: custody_certificate_date < document_date | eval_mutation=no
    """,
    "eform5": """
        outstanding_value: outstanding_value = outstanding_shares * par_value
        planned_capital: planned_raised = offer_shares * min_offer_price
        raised_within_charter: planned_raised <= charter_capital | severity=warning
        report_after_change: latest_change < report_date
    """,
    "eform69": """
        capital_not_decreased: old_capital <= new_capital | severity=warning
        document_after_license: license_date < document_date
        old_representative_id_after_birth: old_birth < old_id_date
        new_representative_id_after_birth: new_birth < new_id_date
    """,
    "eform7": """
        offer_face_value: offer_total = offer_quantity * par_value | mutation_alias=offer_quantity
        secured_covers_offer: offer_total <= secured_value
        guarantee_covers_offer: offer_total <= guarantee_value | severity=warning
        collateral_covers_secured: secured_value <= collateral_value
        outstanding_reconciliation: outstanding_total = outstanding_public + outstanding_private
        raised_reconciliation: raised_total = raised_public + raised_private
        report_after_certificate_change: certificate_change < report_date
    """,
    "eform85": """
        id_after_birth: birth_date < id_date
        certificate_after_id: id_date < certificate_date
    """,
    "eform92": """
        charter_capital: charter_capital = fund_units * unit_par_value
        lot_reconciliation: fund_units = lots * units_per_lot | mutation_alias=lots
        offering_after_license: license_date < offering_certificate_date
    """,
    "eform93": """
        org_investor_count: org_total = org_domestic + org_foreign | null_as_zero=yes
        org_unit_count: org_units_total = org_units_domestic + org_units_foreign | null_as_zero=yes
        org_ratio: org_ratio_total = org_ratio_domestic + org_ratio_foreign | null_as_zero=yes absolute_tolerance=0.01
        individual_investor_count: individual_total = individual_domestic + individual_foreign | null_as_zero=yes
        individual_unit_count: individual_units_total = individual_units_domestic + individual_units_foreign | null_as_zero=yes
        individual_ratio: individual_ratio_total = individual_ratio_domestic + individual_ratio_foreign | null_as_zero=yes absolute_tolerance=0.01
    """,
    "eform94": """
        document_after_certificate: certificate_date < document_date
        old_duration: old_start .. old_end = duration_before | tolerance_days=1
        new_duration: old_start .. new_end = duration_after | tolerance_days=1
        old_capital_product: old_capital = existing_units * par_value
        additional_capital_product: additional_raised = additional_units * issue_price
        post_unit_reconciliation: post_units = existing_units + additional_units
        post_capital_product: post_capital = post_units * par_value
        merged_capital_reconciliation: merged_capital = post_capital + acquired_capital | severity=warning
    """,
}

_OPERATIONS = {"*": "equals_product", "+": "sum_equals", "<=": "less_or_equal", "<": "date_order", "..": "years_between"}
_KINDS = {"relative_tolerance": float, "absolute_tolerance": float, "tolerance_days": int, "null_as_zero": "yes".__eq__, "eval_mutation": "yes".__eq__}


def parse_rule(form: str, line: str) -> Rule:
    """A rule from its line; ValueError for an expression of no known kind."""
    name, _, rest = line.partition(":")
    expression, _, given = rest.partition("|")
    signs = [s for s in _OPERATIONS if f" {s} " in expression]
    if len(signs) != 1:
        raise ValueError(f"no rule: {line.strip()}")
    attributes = dict(x.split("=", 1) for x in given.split())
    more = {k: _KINDS.get(k, str)(v) for k, v in attributes.items()}
    title = " ".join(expression.replace("_", " ").split())
    return Rule(form, f"{form}.{name.strip()}", _OPERATIONS[signs[0]], tuple(re.findall(r"\w+", expression)), title=title, **more)


@cache
def catalogue() -> Catalogue:
    """All shipped rules."""
    return Catalogue(KEYS, tuple(parse_rule(form, line) for form, text in RULES.items() for line in text.strip().splitlines()))
