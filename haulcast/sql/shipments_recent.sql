-- The quoted names with brackets are fixed output names.
SELECT s.shipment_gid,
       s.shipment_xid,
       s.servprov_gid,
       s.total_ship_unit_count,
       s.total_weight,
       s.total_volume,
       s.equipment_gid,
       s.equipment_ref_unit_gid,
       s.icon_gid,
       s.driver_id AS `ATTRIBUTE4(DRIVER_ID)`,
       s.vehicle_no AS `ATTRIBUTE5(VEHICLE_NO)`,
       s.total_actual_cost,
       s.loaded_distance,
       s.dest_location_gid,
       s.principal,
       s.route AS `ATTRIBUTE2(ROUTE)`,
       s.transport_mode_gid,
       s.term_location_text,
       src.location_name AS source_name,
       dst.location_name AS dest_name,
       dst.province AS region,
       dst.city,
       dst.zone1 AS dest_zone1,
       dst.zone2 AS dest_zone2,
       dst.segment,
       s.start_ts,
       s.end_ts
FROM {shipments} s
LEFT JOIN {locations} dst ON dst.location_gid = s.dest_location_gid
LEFT JOIN {locations} src ON src.location_gid = s.source_location_gid
WHERE s.principal = :principal
  AND s.domain_name = :domain
  AND s.perspective = :perspective
  AND s.start_ts >= timestampadd(MONTH, -1, CAST(:as_of AS TIMESTAMP_NTZ))
