SELECT s.shipment_xid,
       s.start_ts,
       s.total_ship_unit_count,
       s.total_weight,
       s.total_volume,
       s.equipment_gid,
       s.principal,
       dst.location_name AS dest_name,
       dst.province AS region,
       dst.city,
       dst.zone1 AS dest_zone1,
       dst.zone2 AS dest_zone2,
       dst.segment
FROM {shipments} s
JOIN {locations} dst ON dst.location_gid = s.dest_location_gid
WHERE s.principal = :principal
  AND s.start_ts BETWEEN timestampadd(MONTH, -25, CAST(:as_of AS TIMESTAMP_NTZ)) AND CAST(:as_of AS TIMESTAMP_NTZ)
  AND s.domain_name LIKE :domain_pattern
  AND s.perspective = :perspective
  AND dst.domain_name LIKE :location_domain_pattern
  AND dst.segment IN (:segment_1, :segment_2, :segment_3, :segment_4)
