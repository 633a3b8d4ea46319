"""SQL expression texts shared by the SQL twins."""

from __future__ import annotations

R2 = "1.27420176e7"  # twice the earth radius in metres


def hav(x1, y1, x2, y2):
    return (f"{R2} * asin(sqrt(pow(sin(radians(({y2}) - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2}))"
            f" * pow(sin(radians(({x2}) - ({x1})) / 2), 2)))")


def km(x1, y1, x2, y2):
    return (f"sqrt(pow((({x1}) - ({x2})) * 1.1132e2 * cos(radians((({y1}) + ({y2})) / 2e0)), 2)"
            f" + pow((({y1}) - ({y2})) * 1.1132e2, 2))")


def txf(lng, z):
    return f"((({lng}) + 180) / 3.6e2 * pow(2e0, {z}))"


def tyf(lat, z):
    s = f"sin(radians(greatest(-8.50511287798066e1, least(8.50511287798066e1, {lat}))))"
    return f"((5e-1 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * pow(2e0, {z}))"


def tx(lng, z):
    return f"CAST(floor({txf(lng, z)}) AS INT)"


def ty(lat, z):
    return f"CAST(floor({tyf(lat, z)}) AS INT)"


def tlng(x, z):
    return f"(({x}) / pow(2e0, {z}) * 360 - 180)"


def tlat(y, z):
    return f"degrees(atan(sinh(pi() * (1 - 2e0 * ({y}) / pow(2e0, {z})))))"


def half_up(x):
    return f"floor(({x}) + 5e-1)"


def clamp(x, lo, hi):
    return f"greatest({lo}, least({hi}, {x}))"


def crosses(lng, lat, x1, y1, x2, y2):
    return f"((({y1}) > ({lat})) <> (({y2}) > ({lat})) AND ({lng}) < ({x1}) + (({lat}) - ({y1})) * (({x2}) - ({x1})) / (({y2}) - ({y1})))"


def utm_select(src):
    """Relation `src` (lng, lat, zone, south) with easting and northing added, in nested steps."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    c = f"{2 * n**0.5 / (1 + n):.17e}"
    s = "sin(radians(lat))"
    east = " + ".join(["eta_"] + [f"{x:.17e} * cos({2 * j} * xi_) * sinh({2 * j} * eta_)" for j, x in enumerate(al, 1)])
    north = " + ".join(["xi_"] + [f"{x:.17e} * sin({2 * j} * xi_) * cosh({2 * j} * eta_)" for j, x in enumerate(al, 1)])
    return f"""(SELECT *, 5e5 + {a:.17e} * ({east}) AS easting,
        CASE WHEN south THEN 1e7 ELSE 0e0 END + {a:.17e} * ({north}) AS northing
      FROM (SELECT *, atan2(t_, cos(dl_)) AS xi_, atanh(sin(dl_) / sqrt(1 + t_ * t_)) AS eta_
        FROM (SELECT *, sinh(atanh({s}) - {c} * atanh({c} * {s})) AS t_, radians(lng - (zone * 6 - 183)) AS dl_ FROM {src})))"""
