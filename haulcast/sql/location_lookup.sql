-- All looked-up columns by one left join. The lookup has one row per key; a key
-- with several locations fails instead of multiplying shipments.
SELECT s.shipment_xid, s.total_volume, d.dest_name, d.dest_zone2
FROM {shipments} s
LEFT JOIN (
  SELECT location_gid,
         any_value(location_name) AS dest_name,
         any_value(zone2) AS dest_zone2,
         assert_true(count(*) = 1, concat('several locations for one key: ', location_gid)) AS only_one
  FROM {locations}
  WHERE location_gid IS NOT NULL
  GROUP BY location_gid
) d ON d.location_gid = s.dest_location_gid AND d.only_one IS NULL
