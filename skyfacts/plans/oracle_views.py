"""The airline tables as SQL text for DuckDB (see airline_views)."""

from __future__ import annotations


def _z(key: str) -> str:
    text = f"cast({key} as varchar)"
    return f"lpad({text}, cast(greatest(length({text}), 6) as integer), '0')"


# Each view: the views it reads, and its text.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "airports": ((), f"""
        select 'A' || {_z('s_suppkey')} as iata_code, s_name as airport, 'CITY ' || s_suppkey as city,
               n_name as country, r_name as continent, 'UTC+' || (s_suppkey % 12) as timezone,
               cast((s_suppkey * 37) % 180 - 90 as double) as latitude,
               cast((s_suppkey * 53) % 360 - 180 as double) as longitude,
               cast((s_suppkey % 5000) / 100.0 as decimal(5, 2)) as airport_tax
        from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
        where s_suppkey % 20 <> 7"""),
    "routes": ((), f"""
        select 'R' || {_z('s_suppkey')} || '-' || i as route_code, 'A' || {_z('s_suppkey')} as origin,
               'A' || {_z('((s_suppkey + i) % n)')} as destination,
               case when s_suppkey % 50 = 11 then 'R-NONE' else 'R' || {_z('s_suppkey')} || '-1' end as parent_route,
               cast(i as smallint) as leg_number,
               case when not (s_suppkey % 10 = 3 and i = 7)
                    then cast(300 + (s_suppkey * 131 + i * 977) % 9000 as integer) end as distance,
               case when not (s_suppkey % 10 = 3 and i = 7)
                    then cast(40 + (s_suppkey * 131 + i * 977) % 600 as smallint) end as flight_minutes
        from supplier, (select unnest(range(1, 8)) as i), (select count(*) as n from supplier)"""),
    "airplanes": ((), f"""
        select 'P' || {_z('p_partkey')} as aircraft_registration, p_brand as model,
               cast(2 as smallint) as seats_business, cast(4 as smallint) as seats_premium,
               cast(14 + p_size as smallint) as seats_economy, cast(p_size % 6 + 1 as smallint) as crew_members,
               date '1990-01-01' + cast(p_partkey * 13 % 9000 as integer) as build_date,
               cast(300 + p_size * 20 as smallint) as fuel_gallons_hour,
               date '2000-01-01' + cast(p_partkey * 7 % 700 as integer) as maintenance_last_acheck,
               date '1999-01-01' + cast(p_partkey * 11 % 900 as integer) as maintenance_last_bcheck,
               cast(p_partkey % 5000 as smallint) as maintenance_takeoffs,
               cast(p_partkey * 7 % 20000 as integer) as maintenance_flight_hours,
               cast(p_partkey * 97 % 5000000 as integer) as total_flight_distance
        from part"""),
    "tickets": ((), f"""
        select ticket_id, passenger_id, flight_id, route_code, departure, class, plane_number, leg, seats, p as price,
               p * t as airport_tax, p * d as local_tax, p * (1 + t + d) as total_amount
        from (select l_orderkey * 10 + l_linenumber as ticket_id, o_custkey as passenger_id,
                     'F' || l_suppkey || '-' || l_linenumber || '-' || (l_partkey % 10) as flight_id,
                     'R' || {_z('l_suppkey')} || '-' || l_linenumber as route_code, l_shipdate as departure,
                     case l_returnflag when 'N' then 'E' when 'A' then 'P' when 'R' then 'B' end as class,
                     l_partkey as plane_number, cast(l_linenumber as smallint) as leg,
                     cast(l_quantity as integer) as seats, cast(l_extendedprice as decimal(12, 2)) as p,
                     cast(l_tax as decimal(4, 2)) as t, cast(l_discount as decimal(4, 2)) as d
              from lineitem left join orders on o_orderkey = l_orderkey)"""),
    "flights": (("tickets",), f"""
        select flight_id, route_code, departure,
               case when min(plane_number) % 97 = 5 then 'P-NONE' else 'P' || {_z('min(plane_number)')} end as airplane,
               max(price) as price_economy, min(leg) as flight_leg
        from tickets group by flight_id, route_code, departure
        union all
        select 'E' || s_suppkey, 'R' || {_z('s_suppkey')} || '-1',
               cast(date '1998-02-27' + cast(s_suppkey % 40 + i as integer) as timestamp),
               case when s_suppkey % 9 = 4 then 'P-NONE' else 'P' || lpad(cast(s_suppkey % 100 + 1 as varchar), 6, '0') end,
               null, cast(1 as smallint)
        from supplier, (select unnest([1, 2]) as i)"""),
    "staff": ((), """
        select c_custkey as empno, c_name as firstnme, 'L' || (c_custkey % 50) as lastname,
               case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
               date '1990-01-01' + cast(c_custkey % 3000 as integer) as hiredate,
               case when c_custkey % 10 = 9 then 'GROUND' else c_mktsegment end as department
        from customer where c_custkey % 97 <> 13"""),
    "flight_crew": (("tickets",), """
        select distinct (passenger_id + i * 37) % n as empno, flight_id, route_code, departure
        from tickets, (select unnest(range(0, 5)) as i), (select count(*) as n from customer)
        where i < seats % 6 and ((passenger_id + i * 37) % n) % 10 <> 9"""),
    "passengers": ((), """
        select c_custkey as id, c_name as firstnme, n_name as country,
               case when c_acctbal > 5000 then 1 else 0 end as vipcard,
               date '1940-01-01' + cast(c_custkey * 31 % 25000 as integer) as birth_date
        from customer join nation on n_nationkey = c_nationkey"""),
    # Prepared facts, written the plain way: one join, one grouping.
    "tickets_agg": (("tickets", "routes"), """
        select origin, cast(sum(airport_tax) as double) / count(airport_tax) as avg_airport_tax,
               cast(sum(local_tax) as double) / count(local_tax) as avg_local_tax,
               cast(sum(total_amount) as double) / count(total_amount) as avg_ticket_value,
               cast(sum(total_amount) as double) as total_revenue, count(*) as ticket_count
        from tickets join routes using (route_code) group by origin"""),
    "tax_report": (("tickets_agg", "airports"), """
        select t.*, airport as origin_airport, city as origin_city, country as origin_country,
               continent as origin_continent, latitude as lat, longitude as lon,
               avg_airport_tax + avg_local_tax as avg_total_tax,
               case when avg_ticket_value <> 0
                    then (avg_airport_tax + avg_local_tax) / avg_ticket_value * 100 end as avg_tax_pct
        from tickets_agg t left join airports on iata_code = origin"""),
    "revenue_rows": (("tickets", "routes", "airports"), """
        select k.departure, k.class, k.total_amount, r.route_code, r.origin, r.destination,
               a.continent, a.country, a.city, b.continent as destination_continent,
               b.country as destination_country, b.city as destination_city
        from tickets k join routes r on r.route_code = k.route_code
             join airports a on a.iata_code = r.origin join airports b on b.iata_code = r.destination"""),
    "revenue": (("revenue_rows",), """
        select cast(year(departure) as bigint) as year, cast(date_trunc('month', departure) as date) as year_month,
               continent, country, city, route_code as route, origin, destination, destination_continent,
               destination_country, destination_city, class, total_amount as revenue
        from revenue_rows"""),
    "staff_counts": (("staff",), """
        select department, count(distinct empno) as staff_count from staff group by department"""),
    "assignments": (("flight_crew", "routes", "staff"), """
        select s.firstnme, s.lastname, c.empno, c.flight_id, c.route_code, c.departure, s.department,
               cast(sum(r.distance) as bigint) as distance, cast(sum(r.flight_minutes) as bigint) as flight_minutes
        from flight_crew c left join routes r on r.route_code = c.route_code left join staff s on s.empno = c.empno
        group by all"""),
    "crew_used": (("flight_crew",), """
        select flight_id, route_code, departure, count(distinct empno) as used_crew
        from flight_crew group by flight_id, route_code, departure"""),
    "usage": (("flights", "airplanes", "crew_used", "routes"), """
        select f.flight_id, f.route_code, r.origin, r.destination, f.departure, f.airplane,
               cast(p.crew_members as bigint) as required_crew, p.model as airplane_model,
               p.aircraft_registration as airplane_reg, u.used_crew
        from flights f left join airplanes p on p.aircraft_registration = f.airplane
             left join crew_used u on (u.flight_id, u.route_code, u.departure) = (f.flight_id, f.route_code, f.departure)
             left join routes r on r.route_code = f.route_code"""),
    "capacity": (("flights", "tickets", "airplanes"), """
        select f.flight_id, f.route_code, f.departure, cast(coalesce(sum(k.seats), 0) as bigint) as tickets_sold,
               cast(any_value(seats_business) as integer) + any_value(seats_premium) + any_value(seats_economy)
                   as total_capacity
        from flights f left join
             tickets k on (k.flight_id, k.route_code, k.departure) = (f.flight_id, f.route_code, f.departure)
             left join airplanes on aircraft_registration = f.airplane
        group by f.flight_id, f.route_code, f.departure"""),
    "occupancy": (("capacity",), """
        select *, case when total_capacity <> 0 then tickets_sold / total_capacity end as capacity_pct,
               route_code as route_id, cast(week(departure) as integer) as week,
               cast(month(departure) as integer) as month, cast(isodow(departure) as integer) as day_of_week,
               strftime(departure, '%Y-%m') as year_month
        from capacity"""),
    "utilisation": (("assignments",), """
        select *, total_hours >= p90_threshold as is_overused, total_hours <= p10_threshold as is_underused
        from (select empno, firstnme, lastname, department, count(*) as total_flights,
                     coalesce(sum(flight_minutes), 0) / 60.0::double as total_hours,
                     count(distinct route_code) as unique_routes
              from assignments group by all) u,
             (select max(total_hours) filter (rn - 1 = floor(0.9 * (n - 1) + 0.5)) as p90_threshold,
                     max(total_hours) filter (rn - 1 = floor(0.1 * (n - 1) + 0.5)) as p10_threshold
              from (select total_hours, row_number() over (order by total_hours) as rn, count(*) over () as n
                    from (select coalesce(sum(flight_minutes), 0) / 60.0::double as total_hours
                          from assignments group by empno, firstnme, lastname, department))) limits"""),
    "fleet": (("flights", "routes", "airplanes"), """
        select aircraft_registration as airplane, model, coalesce(flights, 0) as flights,
               coalesce(distance, 0) as distance, coalesce(minutes, 0) / 60.0::double as flight_hours,
               coalesce(minutes, 0) * fuel_gallons_hour / 60.0::double as fuel_gallons,
               coalesce(minutes, 0) as flight_minutes, cast(fuel_gallons_hour as bigint) as fuel_gallons_hour,
               cast(seats_business + seats_premium + seats_economy as bigint) as seats,
               cast(maintenance_takeoffs as bigint) as maintenance_takeoffs,
               cast(maintenance_flight_hours as bigint) as maintenance_flight_hours,
               datesub('year', build_date, date '2025-01-01') as age_years
        from airplanes left join
             (select f.airplane, count(*) as flights, cast(coalesce(sum(r.distance), 0) as bigint) as distance,
                     cast(coalesce(sum(r.flight_minutes), 0) as bigint) as minutes
              from flights f left join routes r on r.route_code = f.route_code group by f.airplane) used
             on used.airplane = aircraft_registration"""),
    "sales": (("tickets", "passengers"), """
        select k.passenger_id, k.class, k.total_amount, p.country, p.vipcard, p.birth_date
        from tickets k left join passengers p on p.id = k.passenger_id"""),
}


def with_views(body: str, *names: str) -> str:
    """The query text with the named views, and those they read, as leading CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in VIEWS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{name} as ({VIEWS[name][1].strip()})" for name in ordered)
    return f"with {ctes}\n{body.strip()}"
