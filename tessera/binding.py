"""Column roles of a panel table (one row per facility and month).

Every operator takes a ``Binding`` so the same code runs on the canonical panel
and on any other panel-shaped table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Binding:
    facility: str = "clave"
    name: str = "nombre"
    group_id: str = "estado_id"
    group_name: str = "estado"
    zone: str = "zona"
    municipality: str = "municipio"
    locality: str = "localidad"
    year: str = "anio"
    month: str = "mes"
    period: str = "period_key"
    status: str = "situacion"
    connectivity: str = "conectividad"
    lat: str = "lat"
    lng: str = "lng"
    neighbourhood: str = "colonia"
    street: str = "calle"
    number: str = "num"
    postcode: str = "cp"
    # measures compared between periods (output name -> column)
    compare_measures: tuple = (
        ("cn_total", "cn_total"), ("cn_inicial", "cn_inicial"), ("cn_prim", "cn_prim"),
        ("cn_sec", "cn_sec"), ("inc_total", "inc_total"), ("aten_total", "aten_total"))
    # the three certificate levels used by the per-group reports
    levels: tuple = ("cn_inicial", "cn_prim", "cn_sec")
    operating_code: int = 1

    def hierarchy(self) -> list[str]:
        return [self.group_name, self.zone, self.municipality, self.locality, self.facility]

    def with_(self, **kw) -> "Binding":
        return replace(self, **kw)


DEFAULT = Binding()
