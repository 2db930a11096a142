"""Physical features of diesel combustion, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Engine geometry (m, m^3), fuel and gas constants.
STROKE = 0.124
BORE = 0.107
COMPRESSION_RATIO = 17.3
GAS_CONSTANT = 8.31434
POLYTROPIC = 1.35
HEATING_VALUE = 42.64e6
FUEL_MOLE = 0.19065
VALVE_OPENING = -9
STOICHIOMETRIC_AIR = 14.37
NOX_MOLE = 38
CO2_MOLES, WATER_MOLES = 13.883, 12.026
AIR_MOLES_NEEDED = 94.744
# Linear and quadratic coefficients of the heat capacity of CO2, H2O, N2, O2.
HEAT_LINEAR = (4.453, 2.672, 2.927, 3.698)
HEAT_QUADRATIC = (3.140e-3, 3.056e-3, 1.488e-3, 0.6145e-3)

CRANK = STROKE / 2
ROD = 3.5 * CRANK
DISPLACEMENT = math.pi * BORE**2 / 4 * STROKE
CLEARANCE = DISPLACEMENT / (COMPRESSION_RATIO - 1)


def opening_volume() -> float:
    """Cylinder volume at intake valve opening.  The angle enters the cosine as it stands, as a number of radians."""
    c = math.cos(VALVE_OPENING)
    reach = 2 * CRANK * c + math.sqrt(4 * CRANK**2 * c**2 - 4 * (CRANK**2 - ROD**2))
    return reach / 2 * math.pi * BORE**2 / 4


def kelvin(celsius: Column) -> Column:
    return celsius + F.lit(273.0)


def pascal(kilopascal: Column) -> Column:
    return kilopascal * F.lit(1000.0)


def peak_temperature(intake_k: Column) -> Column:
    return intake_k * F.lit((opening_volume() / CLEARANCE) ** (POLYTROPIC - 1))


def peak_pressure(intake_k: Column, intake_pa: Column) -> Column:
    return F.pow(peak_temperature(intake_k) / intake_k, F.lit(POLYTROPIC / (POLYTROPIC - 1))) * intake_pa


def equivalence_ratio(air: Column, fuel: Column) -> Column:
    return F.lit(STOICHIOMETRIC_AIR) / F.try_divide(air, fuel)


def exhaust_oxygen(air: Column, fuel: Column, recirculated: Column) -> Column:
    burnt = F.lit(568 / 167 * 0.98) * fuel
    return F.try_divide(F.lit(0.21) * air - burnt, air + fuel - recirculated)


def cylinder_oxygen(air: Column, fuel: Column, recirculated: Column) -> Column:
    back = exhaust_oxygen(air, fuel, recirculated) * recirculated
    return F.try_divide(F.lit(0.21) * air + back, air + recirculated + fuel)


def injection_rate(rail_mpa: Column, intake_pa: Column) -> Column:
    """Seven nozzle holes of 0.18 mm."""
    area = 0.86 * 7 * math.pi * 0.00018**2 / 4
    return F.lit(area) * F.sqrt(F.lit(2.0 * 872) * (rail_mpa * F.lit(1e6) - intake_pa))


def injection_time(fuel: Column, rail_mpa: Column, intake_pa: Column, rpm: Column) -> Column:
    return F.try_divide(fuel, injection_rate(rail_mpa, intake_pa) * F.lit(30.0) * rpm)


def air_moles(ratio: Column) -> Column:
    return F.try_divide(F.lit(STOICHIOMETRIC_AIR * 190.649), ratio * F.lit(28.84))


def nitrogen_moles(ratio: Column) -> Column:
    return F.lit(0.79) * air_moles(ratio)


def oxygen_moles(ratio: Column) -> Column:
    return (air_moles(ratio) - F.lit(AIR_MOLES_NEEDED)) * F.lit(0.21)


def flame_temperature(ratio: Column, intake_k: Column) -> Column:
    """The positive root of the energy balance, above the peak temperature."""
    n2, o2 = nitrogen_moles(ratio), oxygen_moles(ratio)

    def mix(c: tuple[float, ...]) -> Column:
        return (F.lit(CO2_MOLES * c[0] + WATER_MOLES * c[1]) + n2 * F.lit(c[2]) + o2 * F.lit(c[3])) * F.lit(GAS_CONSTANT)

    linear, half = mix(HEAT_LINEAR), mix(HEAT_QUADRATIC)  # half: twice the quadratic term of the balance
    energy = F.lit(2.0 * HEATING_VALUE * FUEL_MOLE)
    rise = (F.sqrt(linear * linear + half * energy) - linear) / half
    return rise + peak_temperature(intake_k)


def emission_index(nox_gps: Column, fuel: Column) -> Column:
    """Grams of NOx for a kilogram of fuel."""
    return F.try_divide(nox_gps, fuel / F.lit(3600.0))


def index_to_ppm(index: Column, fuel: Column, ratio: Column) -> Column:
    nox = index / F.lit(float(NOX_MOLE)) * fuel
    products = (nitrogen_moles(ratio) + oxygen_moles(ratio) + F.lit(CO2_MOLES + WATER_MOLES)) * fuel / F.lit(FUEL_MOLE)
    return F.try_divide(nox, products + nox) * F.lit(1e6)


def power_law(coefficients: tuple[float, ...], *factors: Column) -> Column:
    """a * x**b * y**c ..."""
    out = F.lit(float(coefficients[0]))
    for c, x in zip(coefficients[1:], factors):
        out = out * F.pow(x, F.lit(float(c)))
    return out
